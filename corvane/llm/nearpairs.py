"""Exact self-join of texts on the Jaccard distance of their word shingles.

The metric space is that of shingle sets under d(x, y) = 1 - |x & y| / |x | y|, and
pairs with d <= 1 - t are wanted. Voronoi regions of whole texts can't divide it:
unrelated texts all lie at distance 1 or just below, and at t = 0.6 the triangle
inequality only rules out regions more than 2 (1 - t) = 0.8 further away, so nearly every
text lies on the boundary of nearly every region (`regions_per_text` measures it). What
follows is therefore a prefix-filter join, whose regions are split where they are large
and joined exactly, as in the method's last step:

* All shingles have one order, by rising corpus frequency as far as a counter table of
  fixed size tells it, else by hash. A partner of x within 1 - t has at least
  a = ceil(t |x|) of x's shingles, and the l-th common one is among the first
  |x| - a + l of x and of y. So x goes to the regions of these shingles, its window, and
  a pair is a candidate if it shares l of them.
* A region of more than REGION texts isn't joined but split: its texts go to the regions
  of {s, s'} for all other s' of their windows. Where these are too large, they are cut
  into blocks, and each pair of blocks is joined by itself. Regions are counted exactly,
  after the shuffle.
* Within a region pairs are pruned by size (t |y| <= |x|) and position, and at last
  verified exactly.

Texts with the same words are one class from the first step on, and so are those that
repeat one shingle only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bounded
from corvane.llm.kernels import U, distinct, jaccard, mix, sequence_hash, shingles, words
from corvane.session import materialize

#: Common shingles of the windows that a candidate must share (l above).
SHARED = 4
#: Texts from which on a region is split.
REGION = 8192
#: Bits of the map of texts that have candidates.
MARK_BITS = 23
#: Rows that are worked through at once, so that two bytes number them.
_ROWS = 10_000
#: Rounded-down sizes and positions, so that one byte holds them.
_SCALE = np.unique(np.floor(1.09 ** np.arange(1, 400)).astype(np.int64))
_SCALE = np.concatenate(([0], _SCALE[_SCALE > 0]))[:128]


def _code(n: np.ndarray) -> np.ndarray:
    return (np.searchsorted(_SCALE, n, side="right") - 1).astype(np.uint8)


def _low(code: np.ndarray) -> np.ndarray:
    return _SCALE[code]


def _high(code: np.ndarray) -> np.ndarray:
    return np.concatenate((_SCALE[1:] - 1, [1 << 40]))[code]


def _class_hash(h: np.ndarray, off: np.ndarray, x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The same for texts with the same words, and for texts that repeat one shingle only."""
    out = sequence_hash(h, off)
    some, first = np.unique(row, return_index=True)
    if len(some):
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        m = low == high
        out[some[m]] = mix(~low[m])
    return out.view(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _scan(width: int, min_words: int, bits: int):
    """Rows (key, doc, seq) of the texts, then the blocks of the task's shingle counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, key_type = ["key", "doc", "seq", "block", "salt", "data"], None
        counts = np.zeros(1 << bits, np.uint32)
        for b in batches:
            key_type = b.column(2).type
            h, off = words(b.column(1).to_pylist())
            n = np.diff(off)
            x, row, _ = shingles(h, off, width)
            keep = np.flatnonzero(n >= max(min_words, width))
            seq = _class_hash(h, off, x, row)[keep]
            np.add.at(counts, bounded.slot(x[n[row] >= min_words], bits), 1)
            none = pa.nulls(len(keep), pa.int32())
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(2).take(at), b.column(0).take(at), pa.array(seq), none, none, pa.nulls(len(keep), pa.binary())], names=names)
        if key_type is not None:
            blocks = bounded.blocks_of(counts, TaskContext.get().partitionId())
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), key_type), none, none, *blocks.columns], names=names)

    return scan


def _in_order(x: np.ndarray, row: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row by frequency and value, in one sort of a joint key.

    The key holds half of the value; where that makes two values look equal, which is
    rare, the batch is sorted by all of it.
    """
    joint = row.astype(U) << U(40) | freq.astype(U) << U(32) | x >> U(32)
    o = np.argsort(joint)
    joint, y = joint[o], x[o]
    same = joint[1:] == joint[:-1]
    if (y[1:][same] != y[:-1][same]).any():
        o = np.lexsort((x, freq, row))
        y = x[o]
        same = (y[1:] == y[:-1]) & (row[o][1:] == row[o][:-1])
    keep = np.concatenate(([True], ~same)) if len(y) else np.zeros(0, bool)
    return y[keep], row[o][keep]


def _window(x: np.ndarray, row: np.ndarray, rows: int, t: float, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The mixed shingles of each row's window in order, with row, rank and the row's number of shingles."""
    x, row = _in_order(x, row, table[bounded.slot(x, bits)])
    n = np.bincount(row, minlength=rows)
    rank = np.arange(len(x)) - (np.cumsum(n) - n)[row]
    size = n[row]
    m = rank < np.minimum(size, size - np.ceil(t * size - 1e-9).astype(np.int64) + SHARED)
    return mix(x[m]), row[m], rank[m], size[m]


def _region(x: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a region and the three bytes that tell it from others of the bucket."""
    return buckets[((x >> U(32)) % U(len(buckets))).astype(np.int64)], (x & U(0xFFFFFF)).astype(np.uint32)


def _even_buckets(spark: SparkSession, least: int) -> np.ndarray:
    """Numbers of buckets that a hash partitioning deals out evenly: as many for each shuffle
    partition, at least `least` in all."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = -(-least // parts)
    # In 40 times as many numbers each partition is met often enough, all but surely; if not, it gets fewer.
    number = spark.range(0, 40 * each * parts).select(F.col("id").cast("int").alias("id"))
    at = number.withColumn("part", F.pmod(F.hash("id"), F.lit(parts)))
    rows = at.groupBy("part").agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("ids")).collect()
    return np.array(sorted(i for r in rows for i in r["ids"]), np.int64)


def _entries(width: int, min_words: int, t: float, buckets: np.ndarray, bits: int, counts):
    """Packed entries of the regions of single shingles.

    A piece holds a bucket's entries of a slice of rows: the numbers of entries and texts,
    for each text its class and size, and for each entry the text's place, three bytes of
    the region and one for the position, with the weight as its highest bit.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _sliced(batches):
            h, off = words(b.column(1).to_pylist())
            x, row, _ = shingles(h, off, width)
            seq = _class_hash(h, off, x, row)
            use = np.zeros(b.num_rows, bool)
            long = np.flatnonzero(np.diff(off) >= max(min_words, width))
            fresh, at = np.unique(seq[long], return_index=True)
            # A task emits each class once; copies met by several tasks are dropped in the region.
            new = np.fromiter((s not in seen for s in fresh.tolist()), bool, len(fresh))
            use[long[at[new]]] = True
            seen.update(fresh[new].tolist())
            x, row = x[use[row]], row[use[row]]
            x, row, rank, size = _window(x, row, b.num_rows, t, bits, counts.value)
            if not len(x):
                continue
            # Texts of few distinct shingles may share fewer than SHARED.
            few = np.ceil(t * size - 1e-9) < SHARED
            mark = _code(rank) | np.where(few, 128, 0).astype(np.uint8)
            bucket, key = _region(x, buckets)
            o = np.argsort(bucket, kind="stable")
            bucket, key, row, size, mark = bucket[o], key[o], row[o], size[o], mark[o]
            begin = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
            other = np.ones(len(row), bool)
            other[1:] = row[1:] != row[:-1]
            other[begin] = True
            place = np.cumsum(other) - 1
            place = (place - np.repeat(place[begin], np.diff(np.append(begin, len(row))))).astype(np.uint16)
            key = key.view(np.uint8).reshape(-1, 4)[:, :3]
            pieces = []
            for lo, hi in zip(begin, [*begin[1:], len(row)], strict=True):
                texts = lo + np.flatnonzero(other[lo:hi])
                head = np.array([hi - lo, len(texts)], np.uint32)
                pieces.append(b"".join(v.tobytes() for v in (head, seq[row[texts]], _code(size[texts]), place[lo:hi], key[lo:hi], mark[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), pa.array(pieces, pa.binary())], names=["bucket", "data"])

    return emit


def _unpack(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Region, class, size, position and weight of all entries of some pieces."""
    parts = []
    for p in pieces:
        n, m = (int(v) for v in np.frombuffer(p, np.uint32, 2))
        at = 8 + 8 * m
        seq, size = np.frombuffer(p, np.int64, m, 8), np.frombuffer(p, np.uint8, m, at)
        at += m
        place = np.frombuffer(p, np.uint16, n, at)
        key = np.frombuffer(p, np.uint8, 3 * n, at + 2 * n).reshape(-1, 3).astype(np.uint32)
        mark = np.frombuffer(p, np.uint8, n, at + 5 * n)
        parts.append((key[:, 0] | key[:, 1] << 8 | key[:, 2] << 16, seq[place], size[place], mark))
    key, seq, size, mark = (np.concatenate(v) for v in zip(*parts, strict=True))
    return key, seq, size, mark & 127, np.where(mark & 128, SHARED, 1)


def _small(t: float) -> int:
    """Texts of at most so many shingles may be partners of one that shares fewer than SHARED."""
    n = 1
    while np.ceil(t * (n + 1) - 1e-9) < SHARED:
        n += 1
    return int(n / t + 1e-9)


def _split(key: np.ndarray, limit: int) -> np.ndarray:
    """Which entries, in order of their regions, lie in one of more than `limit` texts."""
    begin = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1)) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(key)))
    return np.repeat(n > limit, n)


def _meet(key: np.ndarray, low: np.ndarray, high: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) of entries of one region, in order of region and size, that their sizes allow."""
    live, d = np.arange(len(key)), 0
    while len(live):
        d += 1
        live = live[live + d < len(key)]
        live = live[(key[live] == key[live + d]) & (high[live] >= t * low[live + d])]
        if len(live):
            yield live, live + d


_RAW = "a long, b long, w int"
#: The weight of rows (class, region), by which regions to split are told from pairs.
_SPLIT = -(1 << 20)


def _raw(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w.astype(np.int32))], names=["a", "b", "w"])


def _join_bucket(t: float, limit: int):
    """The pairs of a bucket's regions that size and position allow, with their weights, and
    for the regions to split, their texts: rows (class, region, _SPLIT)."""

    def join(bucket: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, size, pos, weight = _unpack([x for b in rows for x in b.column("data").to_pylist()])
        o = np.lexsort((seq, size, key))
        key, seq, size, pos, weight = key[o], seq[o], size[o], pos[o], weight[o]
        one = np.ones(len(key), bool)
        one[1:] = (key[1:] != key[:-1]) | (seq[1:] != seq[:-1])
        key, seq, size, pos, weight = key[one], seq[one], size[one], pos[one], weight[one]
        hot = _split(key, limit)
        if hot.any():
            yield _raw(seq[hot], key[hot].astype(np.int64) | bucket[0].as_py() << 24, np.full(int(hot.sum()), _SPLIT))
            # Texts so small that they may share no further shingle meet here all the same.
            m = ~hot | (_low(size) <= _small(t))
            key, seq, size, pos, weight = key[m], seq[m], size[m], pos[m], weight[m]
        low, high = _low(size), _high(size)
        p_low, p_high = _low(pos), _high(pos)
        for i, j in _meet(key, low, high, t):
            least = np.ceil(t / (1 + t) * (low[i] + low[j]) - 1e-9)
            most = np.minimum(p_high[i], p_high[j]) + 1 + np.minimum(high[i] - p_low[i] - 1, high[j] - p_low[j] - 1)
            m = most >= least
            i, j = i[m], j[m]
            if len(i):
                yield _raw(np.minimum(seq[i], seq[j]), np.maximum(seq[i], seq[j]), np.minimum(weight[i], weight[j]))

    return join


_DEEP = "region long, seq long, size int"


def _split_entries(width: int, t: float, buckets: np.ndarray, bits: int, counts):
    """Entries of the regions of two shingles, one of which has too large a region, from texts
    (seq, text, marks) with the numbers of those regions."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, off = words(b.column("text").to_pylist())
            x, row, _ = shingles(h, off, width)
            x, row, rank, size = _window(x, row, b.num_rows, t, bits, counts.value)
            begin = np.searchsorted(row, np.arange(b.num_rows + 1))
            for i, (seq, marks) in enumerate(zip(b.column("seq").to_pylist(), b.column("marks").to_pylist(), strict=True)):
                v = x[begin[i] : begin[i + 1]]
                bucket, key = _region(v, buckets)
                hot = np.isin(key.astype(np.int64) | bucket << 24, np.array(marks, np.int64))
                # A slice at a time, each large region with every other shingle; two large ones meet once.
                at = np.flatnonzero(hot)
                step = max(1, 1_000_000 // max(1, len(v)))
                for first in range(0, len(at), step):
                    one = np.repeat(at[first : first + step], len(v))
                    two = np.tile(np.arange(len(v)), len(one) // len(v))
                    m = (one != two) & (~hot[two] | (one < two))
                    lo, hi = np.minimum(one[m], two[m]), np.maximum(one[m], two[m])
                    region = mix(v[lo] * U(0x9E3779B97F4A7C15) + v[hi])
                    if len(region):
                        cols = [region.view(np.int64), np.full(len(region), seq, np.int64), np.full(len(region), size[begin[i]], np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["region", "seq", "size"])

    return emit


def _join_blocks(t: float):
    """The pairs of regions and blocks that sizes allow. Two blocks of a region meet where their
    texts are of different ones; a block meets itself apart."""

    def join(bucket: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = pa.Table.from_batches(list(rows))
        region, seq, size, own, lo, hi = (e.column(c).to_numpy() for c in ("region", "seq", "size", "own", "lo", "hi"))
        key = mix(region.view(U) ^ (lo.astype(U) << U(32) | hi.astype(U)) * U(0x9E3779B97F4A7C15))
        o = np.lexsort((seq, size, key))
        one = np.ones(len(o), bool)
        one[1:] = (key[o][1:] != key[o][:-1]) | (seq[o][1:] != seq[o][:-1])
        o = o[one]
        key, seq, size, own, apart = key[o], seq[o], size[o], own[o], (lo != hi)[o]
        for i, j in _meet(key, size, size, t):
            m = ~apart[i] | (own[i] != own[j])
            i, j = i[m], j[m]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(seq[i], seq[j])), pa.array(np.maximum(seq[i], seq[j]))], names=["a", "b"])

    return join


def _in_blocks(deep: DataFrame, limit: int, buckets: int) -> DataFrame:
    """Each entry with its block of the region and, for each other block, the pair of both; a region
    of at most `limit` texts is one block."""
    blocks = deep.groupBy("region").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int")
    each = deep.join(blocks, "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("region", "seq", "size", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return each.withColumn("bucket", F.pmod(F.xxhash64("region", "lo", "hi"), F.lit(buckets)).cast("int"))


def _verify(width: int, t: float, min_words: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j, n_a, n_b = jaccard(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), width)
            m = pa.array((j >= t - 1e-12) & (n_a >= min_words) & (n_b >= min_words))
            yield b.select(["a", "b"]).append_column("overlap", pa.array(j)).filter(m)

    return verify


def _numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.xxhash64(F.col(key)).alias("doc"), F.col(text).cast("string").alias("text"), F.col(key).alias("key")).where("text is not null and key is not null")


def _join(df: DataFrame, key: str, text: str, width: int, t: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Similar pairs (a, b, overlap) of classes, and rows (key, doc, seq) of all texts."""
    spark = df.sparkSession
    base = _numbered(df, key, text)
    texts = base.select("doc", "text")
    bits = bounded.counter_bits(texts.count())
    scanned = materialize(base.mapInArrow(_scan(width, min_words, bits), f"key {dict(base.dtypes)['key']}, doc long, seq long, block int, salt int, data binary"), "near-scan")
    table = bounded.collect_blocks(scanned.where("block is not null").select("block", "salt", "data"), 1 << bits, "uint32", add=True)
    instances = int(table.sum(dtype=np.uint64))
    # Frequencies in steps of a sixteenth of a power of two, in one byte.
    counts = spark.sparkContext.broadcast(np.minimum(8 * np.log2(1.0 + table), 255).astype(np.uint8))
    members = scanned.where("doc is not null").select("key", "doc", "seq")
    reps = members.groupBy("seq").agg(F.min("doc").alias("doc"))
    buckets = _even_buckets(spark, max(1, instances // 2_000_000))
    entries = texts.mapInArrow(_entries(width, min_words, t, buckets, bits, counts), "bucket int, data binary")
    raw = entries.groupBy("bucket").applyInArrow(_join_bucket(t, REGION), _RAW)
    level = materialize(raw.groupBy("a", "b").agg(F.sum("w").alias("w")).where((F.col("w") < 0) | (F.col("w") >= SHARED)), "near-candidates")
    candidates = level.where("w > 0").select("a", "b")
    hot = level.where("w < 0").select(F.col("a").alias("seq"), F.col("b").alias("mark"))
    if not hot.isEmpty():
        # At most one mark for each region that a text's window reaches.
        marks = hot.groupBy("seq").agg(F.collect_set("mark").alias("marks")).join(reps, "seq")
        split = _texts_of(texts, marks).select("seq", "text", "marks")
        deep = materialize(split.mapInArrow(_split_entries(width, t, buckets, bits, counts), _DEEP), "near-split")
        tasks = max(len(buckets), deep.count() // 2_000_000)
        found = _in_blocks(deep, REGION, tasks).groupBy("bucket").applyInArrow(_join_blocks(t), "a long, b long")
        candidates = materialize(candidates.unionByName(found).distinct(), "near-candidates")
    pair = candidates.join(reps.select(F.col("seq").alias("a"), F.col("doc").alias("doc_a")), "a").join(reps.select(F.col("seq").alias("b"), F.col("doc").alias("doc_b")), "b")
    pair = materialize(pair, "near-pairs")
    ends = pair.select(F.col("doc_a").alias("doc")).unionByName(pair.select(F.col("doc_b").alias("doc")))
    few = _texts_of(texts, ends, join=False)
    both = pair.join(few.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(few.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    pairs = both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, t, min_words), "a long, b long, overlap double").dropDuplicates(["a", "b"])
    return pairs, members


def _texts_of(texts: DataFrame, wanted: DataFrame, join: bool = True) -> DataFrame:
    """The texts of some numbers, each once, joined with `wanted` if asked. A map of fixed size keeps the
    others from the shuffle."""
    marked = bounded.hash_bitmap(wanted, "doc", MARK_BITS)
    few = bounded.keep_marked(texts, "doc", marked, MARK_BITS).dropDuplicates(["doc"])
    return few.join(wanted, "doc") if join else few


def similar_texts(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, min_words: int = 15) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar texts and the membership of rows in classes.

    Returns `pairs(a, b, overlap)` between numbers of classes of equal texts, of any size, and
    `members(rep, key)`: row `key` is in the class `rep`. Two rows with the same `rep` are
    copies, between which no pair is listed.

    Null and empty texts and those under `min_words` words are in neither. A key that
    occurs several times counts once if its text is the same. Other columns are ignored.
    The output is the same at every run.
    """
    pairs, members = _join(df, key, text, width, threshold, min_words)
    return pairs, members.select(F.col("seq").alias("rep"), "key").distinct()


def similar_pairs(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, min_words: int = 15) -> DataFrame:
    """All pairs of keys (a < b) whose texts are similar, equal texts included, each once."""
    pairs, members = _join(df, key, text, width, threshold, min_words)
    pairs = materialize(pairs.select("a", "b"), "near-found")
    # Only classes with a partner or with several members are looked up.
    copied = members.groupBy("seq").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("seq")
    paired = pairs.select(F.col("a").alias("seq")).unionByName(pairs.select(F.col("b").alias("seq")))
    some = bounded.keep_marked(members.select("seq", "key"), "seq", bounded.hash_bitmap(paired, "seq", MARK_BITS), MARK_BITS).distinct()
    left, right = (some.select(F.col("seq").alias(x), F.col("key").alias(f"key_{x}")) for x in "ab")
    across = pairs.join(left, "a").join(right, "b").select("key_a", "key_b")
    copies = members.select("seq", "key").distinct().join(copied, "seq", "left_semi")
    within = copies.withColumnRenamed("key", "key_a").join(copies.withColumnRenamed("key", "key_b"), "seq").where("key_a < key_b").select("key_a", "key_b")
    return across.unionByName(within).where("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def regions_per_text(df: DataFrame, key: str, text: str, width: int, thresholds: list[float], pivots: list[int], min_words: int = 15) -> DataFrame:
    """Rows (n_pivots, threshold, n_texts, alone, regions): in how many Voronoi regions a text would lie if
    whole texts were pivots, and the share of texts with no region but their own.

    The pivots are the texts whose keys have the smallest hashes, at most max(pivots), a
    bounded sample. A text goes to the region of its nearest pivot and to each whose pivot
    is at most 2 (1 - threshold) further away.
    """
    base = _numbered(df, key, text).select("doc", "text").where(F.size(F.split(F.col("text"), r"\s+")) >= min_words)
    chosen = [r["text"] for r in base.groupBy("doc").agg(F.min("text").alias("text")).orderBy("doc").limit(max(pivots)).collect()]
    xp, rp = distinct(*shingles(*words(chosen), width)[:2])
    n_p = np.bincount(rp, minlength=len(chosen))
    o = np.argsort(xp, kind="stable")
    shared = df.sparkSession.sparkContext.broadcast((xp[o], rp[o], n_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xp, rp, n_p = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                h, off = words(b.column(1).to_pylist())
                use = np.diff(off) >= max(min_words, width)
                x, row = distinct(*shingles(h, off, width)[:2])
                n = np.bincount(row, minlength=b.num_rows)
                lo, hi = np.searchsorted(xp, x, "left"), np.searchsorted(xp, x, "right")
                m = hi - lo
                hit = np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                common = np.bincount(np.repeat(row, m) * len(n_p) + rp[hit], minlength=b.num_rows * len(n_p)).reshape(b.num_rows, -1)
                d = (1 - common / np.maximum(n[:, None] + n_p[None, :] - common, 1))[use]
                for k in pivots:
                    near = d[:, :k]
                    for t in thresholds:
                        c = (near <= near.min(axis=1, keepdims=True, initial=1) + 2 * (1 - t) + 1e-12).sum(axis=1)
                        cols = [[k], [t], [len(c)], [int((c == 1).sum())], [int(c.sum())]]
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["n_pivots", "threshold", "n_texts", "alone", "regions"])

    counted = base.mapInArrow(run, "n_pivots long, threshold double, n_texts long, alone long, regions long").groupBy("n_pivots", "threshold")
    n = F.sum("n_texts")
    return counted.agg(n.alias("n_texts"), F.round(F.sum("alone") / n, 4).alias("alone"), F.round(F.sum("regions") / n, 2).alias("regions"))
