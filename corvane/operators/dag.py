"""Levels and cycles of dependency graphs held as edges (node, dep)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialize


def _edges(edges: DataFrame, node: str, dep: str) -> DataFrame:
    return materialize(edges.select(F.col(node).alias("node"), F.col(dep).alias("dep")).where("node is not null and dep is not null").distinct(), "dag")


def _forest(e: DataFrame) -> bool:
    """Whether no node has several dependencies."""
    return e.groupBy("node").count().where("count > 1").isEmpty()


def _jump(at: DataFrame) -> DataFrame:
    """Rows (node, up, far) whose `up` is replaced by its own `up`: each jump is twice as long as the last."""
    onward = at.select(F.col("node").alias("up"), F.col("up").alias("up_2"), F.col("far").alias("far_2"))
    return materialize(at.join(onward, "up", "left").select("node", F.col("up_2").alias("up"), (F.col("far") + F.coalesce("far_2", F.lit(0))).alias("far")), "dag")


def levels(edges: DataFrame, node: str = "node", dep: str = "dep") -> DataFrame:
    """Rows (node, level): 0 without dependencies, else one more than the deepest one.

    A row with a null `dep` names a node without dependencies. Where no node has several
    dependencies, ways are doubled, so a chain of n nodes takes log2(n) rounds; else nodes
    are settled in waves, as many as there are levels. An error names how many nodes lie on
    or behind a cycle.
    """
    e = _edges(edges, node, dep)
    todo = edges.select(F.col(node).alias("node")).unionByName(edges.select(F.col(dep).alias("node"))).where("node is not null").distinct()
    todo = materialize(todo, "dag")
    if _forest(e):
        at = materialize(todo.join(e, "node", "left").select("node", F.col("dep").alias("up"), F.col("dep").isNotNull().cast("int").alias("far")), "dag")
        nodes, reached = todo.count(), 1
        while not at.where("up is not null").isEmpty():
            if reached > nodes:
                raise ValueError(f"{at.where('up is not null').count()} nodes lie on or behind a cycle")
            at, reached = _jump(at), 2 * reached
        return at.select("node", F.col("far").alias("level"))
    done, level = None, 0
    while True:
        blocked = e.join(todo.select(F.col("node").alias("dep")), "dep", "left_semi").select("node").distinct()
        ready = todo.join(blocked, "node", "left_anti")
        wave = materialize(ready.withColumn("level", F.lit(level)), "dag")
        if wave.isEmpty():
            left = todo.count()
            if left:
                raise ValueError(f"{left} nodes lie on or behind a cycle")
            return done if done is not None else wave
        done = wave if done is None else done.unionByName(wave)
        todo = materialize(todo.join(wave, "node", "left_anti"), "dag")
        level += 1


def on_cycles(edges: DataFrame, node: str = "node", dep: str = "dep") -> DataFrame:
    """Nodes that can't be settled from either end: those on a cycle or between two cycles.

    Where no node has several dependencies these are the nodes that ways of at least as many
    steps as there are nodes lead to, found by doubling; else both ends are peeled off.
    """
    e = _edges(edges, node, dep)
    n = e.count()
    if _forest(e):
        at, reached = e.select("node", F.col("dep").alias("up"), F.lit(1).cast("long").alias("far")), 1
        while reached <= n:
            at, reached = _jump(at), 2 * reached
            at = at.where("up is not null")
        return at.select(F.col("up").alias("node")).distinct()
    while True:
        e2 = e.join(e.select(F.col("dep").alias("node")).distinct(), "node", "left_semi").join(e.select(F.col("node").alias("dep")).distinct(), "dep", "left_semi")
        e = materialize(e2.select("node", "dep"), "dag")
        m = e.count()
        if m == n:
            return e.select("node").distinct()
        n = m


class Graph:
    """A small graph of Python functions, run in waves of ready nodes."""

    def __init__(self) -> None:
        self.nodes: dict[str, tuple[Callable, set[str]]] = {}

    def add(self, name: str, function: Callable, dependencies: set[str] | None = None) -> None:
        self.nodes[name] = (function, set(dependencies or ()))

    def order(self) -> list[list[str]]:
        """The waves; a missing dependency or a cycle is an error."""
        left = {n: set(d) for n, (_, d) in self.nodes.items()}
        unknown = set().union(*left.values()) - set(left) if left else set()
        if unknown:
            raise ValueError(f"unknown dependencies: {sorted(unknown)}")
        waves = []
        while left:
            ready = sorted(n for n, d in left.items() if not d)
            if not ready:
                raise ValueError(f"cycle among {sorted(left)}")
            waves.append(ready)
            left = {n: d - set(ready) for n, d in left.items() if n not in ready}
        return waves

    def run(self, workers: int = 4) -> dict[str, object]:
        """Each function gets the results so far."""
        results: dict[str, object] = {}
        waves = self.order()
        with ThreadPoolExecutor(workers) as pool:
            for wave in waves:
                now = dict(results)
                results.update(zip(wave, pool.map(lambda n: self.nodes[n][0](now), wave), strict=True))
        return results
