"""Filling containers of fixed capacity with texts measured in tokens.

Only the number of items of each size matters for the packing, and there are at most
as many sizes as a container has tokens. So the instance is a table of at most
`capacity` rows, however many texts there are; it is solved on that, and the solution
is a list of steps, each of which puts a run of equally large items into a run of
containers. Every item then finds its container from its number among those of its
size.

The reduction of Martello and Toth goes first: for the largest item left, the sets that
may share a container with it are looked at, and if one of up to three items dominates
them all it is fixed for good. What stays is packed best-fit, by falling size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.ranks import ranked
from corvane.session import materialize

#: A step: size, first item's number, items, first container, items in each container.
Step = tuple[int, int, int, int, int]


class Packing:
    """The steps that pack `counts` (size to number of items, 1 <= size <= capacity)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {s: c for s, c in counts.items() if c > 0}
        if any(not 1 <= s <= capacity for s in self.left):
            raise ValueError("every size must be between 1 and the capacity")
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.left, 0)
        self.steps: list[Step] = []
        self.containers = 0
        self.fixed = 0
        self._reduce()
        self._best_fit()

    def _take(self, size: int, items: int, first: int, each: int) -> None:
        self.steps.append((size, self.used[size], items, first, each))
        self.used[size] += items
        self.left[size] -= items
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def _largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None

    def _smallest_sum(self, items: int, without: dict[int, int]) -> int | None:
        """The sum of the so many smallest items left, None if there are fewer."""
        total = 0
        for s in self.sizes:
            n = min(items, self.left[s] - without.get(s, 0))
            total += n * s
            items -= n
            if not items:
                return total
        return None

    def _fits(self, most: int, without: dict[int, int]) -> int | None:
        i = bisect.bisect_right(self.sizes, most)
        while i:
            i -= 1
            if self.left[self.sizes[i]] > without.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def _dominating(self, s: int) -> list[int] | None:
        """The companions of an item of size `s` in a set that dominates all others."""
        room = self.capacity - s
        one = self._fits(room, {s: 1})
        if one is None:
            return []
        if one == room:
            return [one]
        two = self._smallest_sum(2, {s: 1})
        if two is None or two > room:
            return [one]
        three = self._smallest_sum(3, {s: 1})
        if three is None or three > room:
            # At most two companions: the smaller one is at most room / 2.
            taken = {s: 1}
            taken[one] = taken.get(one, 0) + 1
            second, half = self._fits(room - one, taken), self._fits(room // 2, {s: 1})
            if second is not None and half is not None and second >= half:
                return [one, second]
        return None

    def _reduce(self) -> None:
        again = True
        while again:
            again = False
            for s in sorted(self.sizes, reverse=True):
                while s in self.left and (rest := self._dominating(s)) is not None:
                    group: dict[int, int] = {}
                    for x in (s, *rest):
                        group[x] = group.get(x, 0) + 1
                    # As often as it stays possible, but the choice is made anew once an item runs out.
                    times = min(self.left[x] // n for x, n in group.items())
                    for x, n in group.items():
                        self._take(x, times * n, self.containers, n)
                    self.containers += times
                    self.fixed += times
                    again = True

    def _best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def put_back(room: int, first: int, n: int) -> None:
            if n and room and self.sizes:
                if room not in open_:
                    bisect.insort(rooms, room)
                    open_[room] = []
                open_[room].append((first, n))

        while self.sizes:
            s = self.sizes[-1]
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:
                room, first = self.capacity, self.containers
                n = -(-self.left[s] // (room // s))
                self.containers += n
            each, items = room // s, self.left[s]
            full = min(n, items // each)
            if full:
                self._take(s, full * each, first, each)
                put_back(room - each * s, first, full)
            part = items - full * each
            if full < n and 0 < part:
                self._take(s, part, first + full, part)
                put_back(room - part * s, first + full, 1)
                full += 1
            put_back(room, first + full, n - full)


def _place(steps: dict[str, dict[int, np.ndarray]]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes, ranks = b.column("container_kind").to_pylist(), b.column("size").to_numpy(), b.column("rank_").to_numpy()
            out = np.zeros(len(sizes), np.int64)
            for kind in set(kinds):
                mine = np.flatnonzero(np.array([k == kind for k in kinds]))
                for size in np.unique(sizes[mine]):
                    if size == 0:
                        continue
                    at = mine[sizes[mine] == size]
                    t = steps[kind][int(size)]
                    i = np.searchsorted(t[:, 0], ranks[at], side="right") - 1
                    out[at] = t[i, 1] + (ranks[at] - t[i, 0]) // t[i, 2]
            none = b.column("unknown").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("container_kind"), pa.array(out, pa.int64(), mask=none), b.column("id_"), b.column("piece_no"), b.column("size")], names=["container_kind", "container_no", "id_", "piece_no", "tokens"])

    return place


def pack(sized: DataFrame, key: str, containers: DataFrame, name: str = "pack") -> DataFrame:
    """Rows (container_kind, container_no, key, piece_no, tokens) for each kind of container.

    `sized` has one row (key, tokens) for each text. A text larger than the capacity fills
    containers of its own and goes on as an item with what is left. An empty text takes no
    room and lies in container 0; a null one has a null container. A repeated key is an
    item for each of its rows. Kinds with a null or non-positive capacity are left out.
    """
    kinds = [(r["container_kind"], int(r["capacity_tokens"])) for r in containers.where("capacity_tokens > 0 and container_kind is not null").select("container_kind", "capacity_tokens").distinct().collect()]
    type_ = dict(sized.dtypes)[key]
    # Sizes are counted once; the sort by range reads its input twice.
    sized = materialize(sized.select(key, "tokens"), "sizes")
    schema = f"container_kind string, container_no bigint, id_ {type_}, piece_no bigint, tokens bigint"
    spark = sized.sparkSession
    if not kinds:
        return spark.createDataFrame([], schema).withColumnRenamed("id_", key)
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds])).alias("k")
    each = sized.select(F.col(key).alias("id_"), F.col("tokens").isNull().alias("unknown"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("n"), kind).select("id_", "unknown", "n", "k.*")
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")).cast("bigint") - 1, F.lit(0).cast("bigint"))
    pieces = each.select("container_kind", "id_", "unknown", "n", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    items = pieces.select("container_kind", "id_", "unknown", "piece_no", F.least("capacity", F.col("n") - F.col("piece_no") * F.col("capacity")).alias("size"))
    numbered = ranked(items, ["container_kind", "size"], ["id_", "piece_no"], name)
    # At most `capacity` rows a kind.
    counts: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    for r in numbered.where("size > 0").groupBy("container_kind", "size").count().collect():
        counts[r["container_kind"]][int(r["size"])] = int(r["count"])
    steps: dict[str, dict[int, np.ndarray]] = {}
    for k, c in kinds:
        by: dict[int, list[tuple[int, int, int]]] = {}
        for size, rank, _, first, per in Packing(counts[k], c).steps:
            by.setdefault(size, []).append((rank, first, per))
        steps[k] = {size: np.array(sorted(t), np.int64) for size, t in by.items()}
    return numbered.mapInArrow(_place(steps), schema).withColumnRenamed("id_", key)


def container_use(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """For each kind: containers, tokens and the share of their room that is used."""
    used = packed.where("container_no is not null and tokens > 0").groupBy("container_kind").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("tokens").alias("tokens"))
    capacity = containers.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).distinct()
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("bigint")
    return used.join(capacity, "container_kind").select("container_kind", "capacity_tokens", "n_containers", "tokens", least.alias("least_containers"), F.round(F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))
