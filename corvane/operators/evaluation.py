"""Statistics of predictions: leaderboards, paired comparisons, intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: USD for a million prompt and completion tokens.
PRICES = (0.59, 0.79)


def is_correct(predicted: Column, gold: Column) -> Column:
    """Equal in any case; null is wrong."""
    return F.coalesce(F.upper(predicted) == F.upper(gold), F.lit(False))


def records(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Prediction records of results (question_id, variant, answer, is_valid, ...) against the gold answers."""
    gold = questions.groupBy("question_id").agg(F.max("answer").alias("correct_answer"))
    r = results.join(gold, "question_id", "left")
    return r.withColumn("is_correct", F.coalesce(F.col("answer") == F.col("correct_answer"), F.lit(False))).withColumn("is_invalid", ~F.coalesce("is_valid", F.lit(False))).withColumnRenamed("answer", "predicted_answer").drop("is_valid")


def cost(prompt: Column, completion: Column, prices: tuple[float, float] = PRICES) -> Column:
    return F.coalesce(prompt, F.lit(0)) / 1e6 * prices[0] + F.coalesce(completion, F.lit(0)) / 1e6 * prices[1]


def leaderboard(p: DataFrame, by: str = "variant") -> DataFrame:
    n = F.count("*")
    share = lambda c: F.avg(F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0)) * 100
    return p.groupBy(by).agg(
        n.alias("n"),
        F.count(F.when(F.col("is_correct"), 1)).alias("correct"),
        F.round(share("is_correct"), 6).alias("accuracy"),
        F.round(share("is_invalid"), 6).alias("invalid"),
        F.round(F.avg("total_tokens"), 6).alias("avg_tokens"),
        F.round(F.avg(F.when(~F.isnan("latency_seconds"), F.col("latency_seconds"))), 6).alias("avg_latency"),
        F.round(F.sum(cost(F.col("prompt_tokens"), F.col("completion_tokens"))), 6).alias("cost"),
    )


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Calls rolled up: their number, tokens and time."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"))


def scores_by_question(p: DataFrame, least: float = 0.5) -> DataFrame:
    """One score a (variant, question): 1 if at least the share `least` of its runs is correct."""
    mean = F.avg(F.when(F.coalesce("is_correct", F.lit(False)), 1.0).otherwise(0.0))
    return p.where("question_id is not null and variant is not null").groupBy("variant", "question_id").agg(F.when(mean >= least, 1).otherwise(0).alias("score"))


def paired(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (question_id, a, b) of the questions that both variants have."""
    left = scores.where(F.col("variant") == a).select("question_id", F.col("score").alias("a"))
    return left.join(scores.where(F.col("variant") == b).select("question_id", F.col("score").alias("b")), "question_id")


def compare(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """For each pair of variants wins, losses and ties of the second, the corrected McNemar
    statistic and the 95 % interval of the mean difference in percent points.

    All pairs are read in one pass: every row goes to the pairs it belongs to.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(f"{x}-{y}").alias("pair"), F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs])).alias("p")
    rows = scores.select("*", sides).where((F.col("variant") == F.col("p.x")) | (F.col("variant") == F.col("p.y")))
    a = F.max(F.when(F.col("variant") == F.col("p.x"), F.col("score"))).alias("a")
    b = F.max(F.when(F.col("variant") == F.col("p.y"), F.col("score"))).alias("b")
    both = rows.groupBy("p.pair", "question_id").agg(a, b).where("a is not null and b is not null").withColumn("d", (F.col("b") - F.col("a")).cast("double"))
    s = both.groupBy("pair").agg(F.count("*").alias("n"), F.count(F.when(F.col("d") > 0, 1)).alias("win"), F.count(F.when(F.col("d") < 0, 1)).alias("loss"), F.count(F.when(F.col("d") == 0, 1)).alias("tie"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    half = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    mean = F.when(F.col("n") > 1, F.col("mean")).otherwise(0.0)
    return s.select("pair", "n", "win", "loss", "tie", F.round(F.col("mean") * 100, 6).alias("delta"), F.round(mcnemar(F.col("win"), F.col("loss")), 6).alias("statistic"), F.round((mean - half) * 100, 6).alias("low"), F.round((mean + half) * 100, 6).alias("high"))


def mcnemar(win: Column, loss: Column) -> Column:
    """(|b - c| - 1)^2 / (b + c); 0 without any difference."""
    n = win + loss
    return F.when(n > 0, F.pow(F.abs(win - loss) - 1.0, F.lit(2)) / n).otherwise(0.0)


def mcnemar_p(win: int, loss: int) -> float:
    n = win + loss
    return math.erfc(math.sqrt((abs(win - loss) - 1) ** 2 / n / 2)) if n else 1.0


def exact_p(win: int, loss: int) -> float:
    """Two-sided binomial p."""
    n, k = win + loss, min(win, loss)
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(math.exp(x) for x in logs))


def with_p_values(compared: DataFrame) -> DataFrame:
    """A row for each pair, so of Python calls too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = list(zip(f["win"], f["loss"], strict=True))
            yield f.assign(p_value=[round(mcnemar_p(int(a), int(b)), 9) for a, b in pairs], p_exact=[round(exact_p(int(a), int(b)), 9) for a, b in pairs])

    return compared.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in compared.dtypes) + ", p_value double, p_exact double")


def bootstrap(paired_: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row (n, mean, low, high): the percentile interval of the mean difference in points.

    A paired difference is -1, 0 or 1, so a resample is a draw from a multinomial of the
    three counts; no row is drawn.
    """
    counts = paired_.groupBy((F.col("b") - F.col("a")).alias("d")).count()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        c = {int(d): int(n) for d, n in zip(f["d"], f["count"], strict=True)}
        n = sum(c.values())
        draws = np.random.default_rng(seed).multinomial(n, [c.get(d, 0) / n for d in (-1, 0, 1)], resamples)
        means = (draws[:, 2] - draws[:, 0]) / n * 100
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"n": [n], "mean": [(c.get(1, 0) - c.get(-1, 0)) / n * 100], "low": [low], "high": [high]})

    return counts.withColumn("all_", F.lit(1)).groupBy("all_").applyInPandas(run, "n long, mean double, low double, high double")


def finding(delta: Column) -> Column:
    return F.when(delta > 0, "gain").when(delta < 0, "drop").otherwise("same")


def losses(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Questions that `a` has right and `b` wrong, or both wrong."""
    p = paired(scores, a, b)
    kind = F.when((F.col("a") == 1) & (F.col("b") == 0), "loss").when((F.col("a") == 0) & (F.col("b") == 0), "both_wrong")
    return p.withColumn("kind", kind).where("kind is not null").select("question_id", "kind")


def pivot_by_question(p: DataFrame, variants: list[str]) -> DataFrame:
    """A row for each question with the first answer of each variant, by record."""
    first = F.min_by(F.coalesce("predicted_answer", F.lit("-")), "record_id")
    return p.where(F.col("variant").isin(variants)).groupBy("question_id").pivot("variant", variants).agg(first)


def savings(hits: DataFrame, query: str, before: str, after: str) -> DataFrame:
    """For each query the words of its contexts before and after, and the share saved."""
    from corvane.functions.text import token_count

    s = hits.groupBy(query).agg(F.sum(token_count(before)).alias("words_before"), F.sum(token_count(after)).alias("words_after"))
    return s.withColumn("saved", F.round((F.col("words_before") - F.col("words_after")) / F.greatest("words_before", F.lit(1)) * 100, 6))


def throughput(p: DataFrame, by: str = "variant") -> DataFrame:
    """Correct, total, and time and tokens for each; a missing total counts as one."""
    ok = F.when(~F.isnan("latency_seconds"), F.col("latency_seconds")).otherwise(0.0)
    n = F.greatest(F.count("*"), F.lit(1))
    return p.groupBy(by).agg(F.count(F.when(F.col("is_correct"), 1)).alias("correct"), F.count("*").alias("total"), F.round(F.sum(ok) / n, 6).alias("time_each"), F.round(F.sum(F.coalesce("total_tokens", F.lit(0))) / n, 6).alias("tokens_each"))


def causes(p: DataFrame, by: str = "variant") -> DataFrame:
    """Wrong records by cause: no answer, an error, an invalid reply or a wrong letter."""
    a = F.upper(F.trim("predicted_answer"))
    cause = F.when(F.coalesce("is_correct", F.lit(False)), None).when(a.isNull(), "missing").when(a == "ERR", "error").when(F.col("is_invalid"), "invalid").otherwise("wrong")
    return p.withColumn("cause", cause).where("cause is not null").groupBy(by, "cause").agg(F.count("*").alias("n"))
