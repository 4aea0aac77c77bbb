"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node of an edge, with the smallest node it is linked to.

    Large and small stars in turn: the number of rounds grows with the logarithm of the
    longest chain, and a node's neighbours are never gathered. Each round is written to
    the scratch folder. Loops give a component of one; edges with a null end are left out.
    An error ends a run that isn't settled after `most_rounds`.
    """
    given = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    e = materialize(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    for _ in range(most_rounds):
        now = _mark(e)
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "components")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        hang = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hang.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e = materialize(small, "components")
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = given.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
