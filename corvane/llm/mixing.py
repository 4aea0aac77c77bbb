"""A mixture of sources in which each has its target share of all tokens.

For each source the texts are counted by their exact length. Which texts to take is
then a bounded subset-sum problem over (length, count) for a budget of tokens, and its
table has one row per length. Whole rounds over the source come first; of the rest most
is taken evenly over all lengths, so that the choice doesn't favour any, and the last
stretch is filled to the token by dynamic programming. Which texts of a length are
taken is drawn by a seeded hash.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.ranks import ranked

#: The dynamic program gets at least this many tokens to fill, and at least four of the longest texts.
EXACT = 1 << 15
#: Tokens to fill from which on the program isn't widened any more.
WIDEST = 1 << 24


def subset_sum(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each length give the largest sum up to `budget`.

    Bounded knapsack over bit sets: bit i of a set says that the sum i can be reached. An
    amount c of one length is split into 1, 2, 4, ... and the rest, which covers 0..c. All
    is divided by the lengths' common divisor first, and it ends once the budget is met.
    """
    unit = gcd(*counts) if counts else 1
    budget //= unit
    mask = (1 << (budget + 1)) - 1
    reach, layers = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], budget // (length // unit))
        step = 1
        while left and not reach >> budget & 1:
            n = min(step, left)
            left -= n
            step *= 2
            layers.append((length, n, reach))
            reach |= (reach << (length // unit * n)) & mask
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, n, before in reversed(layers):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + n
            at -= length // unit * n
    return taken


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each length to take for a sum close to and not above `budget`.

    Most is taken evenly over all lengths; what lacks is left to the dynamic program, all
    of it. Where that can't meet the budget it gets four times as much to fill, until
    nothing is taken evenly, and the sum is the largest there is, or it has WIDEST tokens.
    """
    total = sum(s * c for s, c in counts.items())
    if budget >= total:
        return dict(counts)
    room = max(EXACT, 4 * max(counts))
    while True:
        even = max(0, budget - room)
        taken = {s: c * even // total for s, c in counts.items()}
        left = budget - sum(s * c for s, c in taken.items())
        # Rounding down leaves up to one text of each length; the longest that fit go first.
        for s in sorted(counts, reverse=True) if even else ():
            n = min(counts[s] - taken[s], max(0, left - room) // s)
            taken[s] += n
            left -= n * s
        for s, n in subset_sum({s: counts[s] - taken[s] for s in counts if counts[s] > taken[s]}, left).items():
            taken[s] += n
            left -= n * s
        if not left or not even or room >= WIDEST:
            return taken
        room *= 4


#: Most rows (source, length) of a plan that are sent to all executors; beyond it the join is shuffled.
MOST_STEPS = 500_000


def plan(lengths: dict[str, dict[int, int]], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, dict[str, int], dict[str, dict[int, tuple[int, int]]]]:
    """The total, each source's budget, and for each source and length (whole rounds, further texts).

    Without a `total` it is the largest at which every source that has texts reaches its
    share. A source that can't reach its budget gives all it may.
    """
    tokens = {s: sum(n * c for n, c in lengths.get(s, {}).items()) for s in shares}
    room = {s: tokens[s] * repeats[s] for s in shares}
    able = [s for s in shares if room[s] > 0 and shares[s] > 0]
    if total is None:
        have = sum(shares[s] for s in able)
        total = int(min((room[s] / (shares[s] / have) for s in able), default=0))
        budgets = {s: int(round(total * shares[s] / have)) if s in able else 0 for s in shares}
    else:
        budgets = {s: int(round(total * shares[s])) for s in shares}
    choice: dict[str, dict[int, tuple[int, int]]] = {}
    for s in able:
        budget = min(budgets[s], room[s])
        rounds = min(budget // tokens[s], repeats[s])
        most, more = -1, {}
        # Whole rounds and each text once more at most, where that meets the budget; else some
        # texts more often, at last with a round less to have more to choose among.
        for even, times in ((rounds, 1), (rounds, repeats[s] - rounds), (rounds - 1, repeats[s] - rounds + 1)):
            if even < 0 or even + times > repeats[s] or most == budget:
                continue
            some = {n: even * lengths[s][n] + m for n, m in fill({n: c * times for n, c in lengths[s].items()}, budget - even * tokens[s]).items()}
            got = sum(n * m for n, m in some.items())
            if got > most:
                most, more = got, some
        if rounds == repeats[s]:
            more = {n: rounds * c for n, c in lengths[s].items()}
        choice[s] = {n: divmod(more.get(n, 0), c) for n, c in lengths[s].items()}
    return total, budgets, choice


def mix(sized: DataFrame, key: str, targets: DataFrame, seed: int = 42, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, tokens, uses) and its shares by source.

    `sized` has rows (key, source, fingerprint, tokens). Equal texts (by fingerprint) are
    one text: the smallest key stands for all of them, with its source, so that no text is
    used more than `max_repeats` times in all. Texts without tokens, unlisted and null
    sources give nothing. Targets of a source listed twice are added up, with the smaller
    cap. `targets` must be small, one row for each source.
    """
    rows = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("cap")).collect()
    shares = {r["source"]: max(0.0, float(r["share"])) for r in rows}
    repeats = {r["source"]: max(0, int(r["cap"])) for r in rows}
    spark = sized.sparkSession
    listed = sized.where(F.col("source").isin(sorted(shares)) & (F.col("tokens") > 0))
    one = listed.groupBy("fingerprint").agg(F.min(F.struct(F.col(key).alias("k"), "source", "tokens")).alias("m")).select(F.col("m.k").alias("id_"), "m.source", "m.tokens")
    drawn = one.withColumn("draw_", F.xxhash64(F.lit(seed), F.col("id_")))
    numbered = ranked(drawn, ["source", "tokens"], ["draw_", "id_"], "mix")
    # One row for each source and length: at most as many as the longest text has tokens, by source.
    lengths: dict[str, dict[int, int]] = {}
    for r in numbered.groupBy("source", "tokens").count().collect():
        lengths.setdefault(r["source"], {})[int(r["tokens"])] = int(r["count"])
    whole, budgets, choice = plan(lengths, shares, repeats, total)
    chosen = [(s, n, rounds, more) for s, by in choice.items() for n, (rounds, more) in by.items()]
    steps = spark.createDataFrame(chosen, "source string, tokens bigint, rounds_ bigint, more_ bigint")
    uses = F.col("rounds_") + (F.col("rank_") < F.col("more_")).cast("bigint")
    drawn = numbered.join(F.broadcast(steps) if len(chosen) <= MOST_STEPS else steps, ["source", "tokens"])
    mixture = drawn.select(F.col("id_").alias(key), "source", "tokens", uses.alias("uses")).where("uses > 0")
    # What was really reached is counted from the mixture's rows.
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"), F.count("*").alias("n_texts"), F.max("uses").alias("most_uses"))
    asked = spark.createDataFrame([(s, shares[s], repeats[s], whole, budgets[s]) for s in sorted(shares)], "source string, target_share double, max_repeats int, mixture_tokens bigint, budget_tokens bigint")
    report = asked.join(got, "source", "left").fillna(0, ["actual_tokens", "n_texts", "most_uses"])
    share = F.when(F.sum("actual_tokens").over(Window.partitionBy()) > 0, F.col("actual_tokens") / F.sum("actual_tokens").over(Window.partitionBy())).otherwise(0.0)
    report = report.withColumn("actual_share", share).select(*asked.columns, "actual_tokens", "actual_share", "n_texts", F.col("most_uses"))
    return mixture, report
