"""One form for texts that read the same on screen.

A batch of texts is one array of code points. A table maps each code point to its
replacement (none, one or several code points): canonical decomposition, width forms
and joined letters taken apart, invisible characters dropped, kinds of blank and of
line break united, and letters and signs drawn alike in another script given one
representative. The replacements are gathered at once, marks are put in canonical
order and composed again, all over whole arrays.

Left as they are: case, accents, punctuation, superscripts, line breaks and the number
of blanks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.kernels import U, mix
from corvane.session import materialize

# Letters and signs drawn alike, each row "representative: its doubles".
ALIKE = """
A: Α А
B: Β В
C: Ϲ С Ⅽ
D: Ⅾ
E: Ε Е
F: Ϝ
G: Ԍ
H: Η Н
I: Ι І Ӏ Ⅰ
J: Ϳ Ј
K: Κ К K
L: Ⅼ
M: Μ М Ϻ Ⅿ
N: Ν
O: Ο О
P: Ρ Р
Q: Ԛ
S: Ѕ
T: Τ Т
V: Ѵ Ⅴ
W: Ԝ
X: Χ Х Ⅹ
Y: Υ У Ү
Z: Ζ
a: а ɑ
c: ϲ с ⅽ
d: ԁ ⅾ
e: е
g: ɡ
h: һ
i: і ⅰ
j: ϳ ј
l: ⅼ ӏ
m: ⅿ
o: ο о օ
p: р
q: ԛ
s: ѕ
v: ν ѵ ⅴ
w: ԝ
x: х ⅹ
y: у
æ: ӕ
Æ: Ӕ
μ: µ
Γ: Г
Λ: Л
Π: П
Φ: Ф
Ω: Ω
ə: ә
-: ‐ ‑ − ﹣
·: · ‧ ∙ ⋅
;: ;
:: ∶ ։
/: ⁄ ∕
|: ∣ ǀ
~: ∼
!: ǃ
': ʹ ʼ
’: ʼ
"""
#: Characters without any picture, as first and last code point.
INVISIBLE = "00AD 00AD, 034F 034F, 061C 061C, 115F 1160, 17B4 17B5, 180B 180F, 200B 200F, 202A 202E, 2060 206F, 3164 3164, FE00 FE0F, FEFF FEFF, FFA0 FFA0, FFF9 FFFB, E0000 E0FFF, 0000 0008, 000E 001F, 007F 0084, 0086 009F"
#: Kinds of blank.
BLANKS = "0009 00A0 1680 2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200A 202F 205F 3000"
#: Kinds of line break.
BREAKS = "000B 000C 000D 0085 2028 2029"
#: Scripts, by the names of their letters, of which ICU's data tell the letters drawn like those of Latin.
FURTHER_SCRIPTS = ("ARMENIAN", "CHEROKEE", "COPTIC", "LISU", "DESERET", "OSAGE", "TIFINAGH", "OLD ITALIC", "LYCIAN", "CARIAN", "LYDIAN", "GOTHIC", "WARANG CITI", "MIAO", "GEORGIAN", "ELBASAN", "RUNIC")
_tables: dict[str, tuple] = {}
_confusables: dict[str, str] = {}


def confusables(spark: SparkSession) -> str:
    """Further rows "representative: doubles" from ICU's confusables data, asked once on the driver.

    Letters of FURTHER_SCRIPTS go to the one ASCII letter of the same skeleton. Letters of
    these, Greek and Cyrillic whose skeleton no ASCII character has go to one of them. What `ALIKE` lists stays as it is there.
    """
    if "icu" not in _confusables:
        builder = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")
        checker = builder().build()

        def skeletons(chars: list[str]) -> list[str]:
            return checker.getSkeleton("\n".join(chars)).split("\n")

        ascii_ = [chr(c) for c in range(0x21, 0x7F)]
        holders: dict[str, list[str]] = {}
        for c, x in zip(ascii_, skeletons(ascii_), strict=True):
            holders.setdefault(x, []).append(c)
        listed = {x for line in ALIKE.strip().splitlines() for x in line.replace(":", " ").split()}
        letters = []
        for n in range(0x80, 0x20000):
            c = chr(n)
            if c not in listed and unicodedata.category(c)[0] == "L" and unicodedata.name(c, "").startswith((*FURTHER_SCRIPTS, "GREEK", "CYRILLIC")) and unicodedata.normalize("NFKD", c) == c:
                letters.append(c)
        doubles: dict[str, list[str]] = {}
        for c, x in zip(letters, skeletons(letters), strict=True):
            have = holders.get(x, [])
            latin = [a for a in have if a.isalpha()]
            if len(x) != 1:
                continue
            if not have:
                doubles.setdefault(x, []).append(c)
            elif len(latin) == 1 and unicodedata.name(c).startswith(FURTHER_SCRIPTS):
                doubles.setdefault(latin[0], []).append(c)
        rows = []
        for to, some in sorted(doubles.items()):
            # Where no ASCII letter stands for them, one of the Russian or else of the Greek alphabet does.
            first = to if to.isascii() else min(some, key=lambda c: (not "А" <= c <= "я", not "Α" <= c <= "ω", c))
            if rest := [c for c in some if c != first]:
                rows.append(f"{first}: {' '.join(rest)}")
        _confusables["icu"] = "\n".join(rows)
    return _confusables["icu"]


def _build(more: str) -> tuple:
    """Lengths and offsets of the replacements, the replacements, combining classes,
    and the sorted pairs of base and mark with their composites."""
    alike = {}
    for line in (ALIKE.strip() + "\n" + more).strip().splitlines():
        to, doubles = line[0], line[2:].split()
        for x in doubles:
            alike.setdefault(x, to)
    drop, blank, line = set(), {int(x, 16) for x in BLANKS.split()}, {int(x, 16) for x in BREAKS.split()}
    for x in INVISIBLE.split(", "):
        a, b = (int(y, 16) for y in x.split())
        drop.update(range(a, b + 1))
    out, ccc, pairs = {}, np.zeros(0x110000, np.uint8), []
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        s = chr(c)
        ccc[c] = unicodedata.combining(s)
        if c in drop:
            out[c] = ""
        elif c in blank:
            out[c] = " "
        elif c in line:
            out[c] = "\n"
        else:
            kind = unicodedata.decomposition(s)
            wide = kind.startswith(("<wide>", "<narrow>")) or (kind.startswith("<compat>") and (0xFB00 <= c <= 0xFB06 or 0xFB13 <= c <= 0xFB17 or c in (0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3)))
            full = unicodedata.normalize("NFKD" if wide else "NFD", s)
            full = "".join(alike.get(x, x) for x in full)
            if full != s:
                out[c] = full
            if kind and not kind.startswith("<") and " " in kind and unicodedata.normalize("NFC", s) == s:
                a, b = (int(x, 16) for x in kind.split())
                pairs.append((a << 21 | b, c))
            elif 0xAC00 <= c <= 0xD7A3:
                i = c - 0xAC00
                pairs.append(((0x1100 + i // 588) << 21 | (0x1161 + i % 588 // 28), c) if i % 28 == 0 else ((c - i % 28) << 21 | (0x11A7 + i % 28), c))
    pairs.sort()
    length = np.ones(0x110000, np.int64)
    first = np.arange(0x110000, dtype=np.uint32)
    extra_at, extra = np.zeros(0x110000, np.int64), []
    for c, to in out.items():
        length[c] = len(to)
        if to:
            first[c] = ord(to[0])
        if len(to) > 1:
            extra_at[c] = len(extra)
            extra.extend(map(ord, to[1:]))
    keys, made = np.array([k for k, _ in pairs], np.int64), np.array([c for _, c in pairs], np.uint32)
    second = np.zeros(0x110000, bool)
    second[keys & 0x1FFFFF] = True
    return length, first, extra_at, np.array(extra, np.uint32), ccc, keys, made, second


def tables(more: str = "") -> tuple:
    if more not in _tables:
        _tables[more] = _build(more)
    return _tables[more]


def _order_marks(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks after one base in the order of their classes."""
    k = ccc[cp]
    if not ((k[1:] > 0) & (k[:-1] > k[1:]) & (row[1:] == row[:-1])).any():
        return cp, row
    new = (k == 0) | np.concatenate(([True], row[1:] != row[:-1]))
    o = np.lexsort((k, np.cumsum(new)))
    return cp[o], row[o]


def _compose(cp: np.ndarray, row: np.ndarray, ccc: np.ndarray, keys: np.ndarray, made: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition: each turn joins at most one mark to each base."""
    while True:
        can = second[cp]
        if not can.any():
            return cp, row
        k = ccc[cp].astype(np.int64)
        at = np.arange(len(cp))
        begins = np.concatenate(([True], row[1:] != row[:-1]))
        base = np.maximum.accumulate(np.where((k == 0) | begins, at, -1))
        # A mark whose base is the character before it by position of starters: for starters, the previous one.
        prev = np.concatenate(([-1], base[:-1]))
        mark = np.flatnonzero(can & ~begins & (prev >= 0))
        b = np.where(k[mark] > 0, base[mark], prev[mark])
        # Not blocked: nothing between, or only marks of a lower class.
        between = np.where(mark - b > 1, k[mark - 1], -1)
        free = (between < k[mark]) & (k[b] == 0) & (between != 0)
        mark, b = mark[free], b[free]
        pair = cp[b].astype(np.int64) << 21 | cp[mark]
        i = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[i] == pair
        mark, b, i = mark[hit], b[hit], i[hit]
        if not len(mark):
            return cp, row
        b, one = np.unique(b, return_index=True)
        cp = cp.copy()
        cp[b] = made[i[one]]
        keep = np.ones(len(cp), bool)
        keep[mark[one]] = False
        cp, row = cp[keep], row[keep]


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and how many each has. Null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    lead = (raw & 0xC0) != 0x80
    start = np.flatnonzero(lead)
    cp = raw[start].astype(np.uint32)
    upto = np.concatenate(([0], np.cumsum(lead)))[at]
    if len(start) < len(raw):
        # Longer characters: the leading byte tells their number of bytes, each further one holds six bits.
        for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
            m = np.flatnonzero((raw[start] >= low) & (raw[start] < high))
            v = cp[m] & (0x3F >> more)
            for k in range(1, more + 1):
                v = v << 6 | (raw[start[m] + k] & 0x3F)
            cp[m] = v
    return cp, np.diff(upto)


def encode(cp: np.ndarray, counts: np.ndarray, missing: pa.Array | None = None) -> pa.Array:
    """Texts from code points and the number each has; the inverse of `decode`. Null where `missing` is true."""
    width = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
    end = np.cumsum(width)
    raw = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    start = end - width
    for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        m = np.flatnonzero(width == n)
        for k in range(n):
            byte = cp[m] >> np.uint32(6 * (n - 1 - k))
            raw[start[m] + k] = (byte | mark if k == 0 else byte & 0x3F | 0x80).astype(np.uint8)
    upto = np.concatenate(([0], np.cumsum(counts)))
    offsets = np.concatenate(([0], end))[upto].astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(raw))
    return out if missing is None else pc.if_else(missing, pa.scalar(None, pa.large_string()), out)


#: Characters that are worked through at once, which keeps the arrays in cache; a longer text is a block of its own.
BLOCK = 1 << 19


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
        yield at, stop
        at = stop


def forms(texts: pa.Array, more: str = "") -> pa.Array:
    """The form of each text. Null stays null."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts
    parts = []
    for at, stop in _blocks(texts):
        some = texts.slice(at, stop - at)
        parts.append(encode(*form_points(*decode(some), more), pc.is_null(some) if some.null_count else None))
    return pa.concat_arrays(parts)


def canonical(texts: list[str | None], more: str = "") -> list[str | None]:
    """The form of each text of a list."""
    return forms(pa.array(texts, pa.string()), more).to_pylist()


def form_points(cp: np.ndarray, counts: np.ndarray, more: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts' forms, and how many each has."""
    length, first, extra_at, extra, ccc, keys, made, second = tables(more)
    row = np.repeat(np.arange(len(counts)), counts)
    if len(cp) > 1:
        # The line feed of a pair with a carriage return goes.
        pair = np.concatenate(([False], (cp[1:] == 10) & (cp[:-1] == 13) & (row[1:] == row[:-1])))
        if pair.any():
            cp, row = cp[~pair], row[~pair]
    size = length[cp]
    at = np.cumsum(size) - size
    total = int(size.sum())
    new, new_row = np.empty(total, np.uint32), np.repeat(row, size)
    some = size > 0
    new[at[some]] = first[cp[some]]
    long = np.flatnonzero(size > 1)
    if len(long):
        rest = size[long] - 1
        inner = np.arange(int(rest.sum())) - np.repeat(np.cumsum(rest) - rest, rest)
        new[np.repeat(at[long] + 1, rest) + inner] = extra[np.repeat(extra_at[cp[long]], rest) + inner]
    new, new_row = _order_marks(new, new_row, ccc)
    new, new_row = _compose(new, new_row, ccc, keys, made, second)
    return new, np.bincount(new_row, minlength=len(counts))


def _numbers(cp: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit numbers of each text: sums over its characters, each mixed with its place."""
    begin = np.cumsum(counts) - counts
    place = (np.arange(len(cp)) - np.repeat(begin, counts)).astype(U)
    x = place << U(21) | cp
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(x * U(salt) + U(salt >> 7)), dtype=U)))
        out.append(mix(total[begin + counts] - total[begin] + counts.astype(U) * U(salt)).view(np.int64))
    return out[0], out[1]


def with_canonical(df: DataFrame, text: str, into: str = "canonical") -> DataFrame:
    """`df` with the form of column `text` in a column `into`, which replaces one of that name.

    Null stays null, empty stays empty; a text without any visible character becomes one
    of blanks and line breaks or an empty one.
    """
    more = confusables(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return forms(texts, more).cast(pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return df.withColumn(into, F.arrow_udf(run, T.StringType())(F.col(text).cast("string")))


_NUMBERED = "form long, form_2 long, raw long, raw_2 long"


def _keyed(key: str, more: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = None
        for whole in batches:
            texts = whole.column(1)
            for at, stop in _blocks(texts):
                cp, counts = decode(texts.slice(at, stop - at))
                new, n = form_points(cp, counts, more)
                # Texts with a visible character: one that isn't a blank or a line break.
                if blank is None:
                    blank = np.fromiter((chr(c).isspace() for c in range(0x110000)), bool, 0x110000)
                seen = np.concatenate(([0], np.cumsum(~blank[new])))
                end = np.cumsum(n)
                use = np.flatnonzero(seen[end] > seen[end - n])
                numbers = [v[use] for v in (*_numbers(new, n), *_numbers(cp, counts))]
                yield pa.RecordBatch.from_arrays([whole.column(0).take(pa.array(use + at)), *map(pa.array, numbers)], names=[key, *[c.split()[0] for c in _NUMBERED.split(", ")]])

    return run


def _spellings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, form, form_2, raw, raw_2) of the texts whose form occurs in several spellings."""
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).cast("string")).mapInArrow(_keyed(key, confusables(df.sparkSession)), f"`{key}` {kind}, {_NUMBERED}")
    rows = materialize(rows.distinct(), "forms")
    raw = F.struct("raw", "raw_2")
    varied = rows.groupBy("form", "form_2").agg(F.min(raw).alias("lo"), F.max(raw).alias("hi")).where("lo <> hi").select("form", "form_2")
    return rows.join(varied, ["form", "form_2"], "left_semi")


def same_looking(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b) whose texts differ in characters but have one form.

    Texts that are null or without a visible character are never in a pair, and neither
    are equal texts. Only 128-bit numbers of the texts are shuffled, and of these only
    forms that occur in several spellings are joined.
    """
    some = _spellings(df, key, text)
    a, b = (some.select("form", "form_2", F.col(key).alias(f"key_{x}"), F.struct("raw", "raw_2").alias(f"raw_{x}")) for x in "ab")
    return a.join(b, ["form", "form_2"]).where("key_a < key_b and raw_a <> raw_b").select("key_a", "key_b").distinct()


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, class, n_keys, n_spellings) of the texts that look like others of other characters:
    `class` is the smallest key with the same form, of which there are n_keys in n_spellings.

    A key whose texts differ counts for each of them. Rows aren't paired, so a form with many
    copies costs one row for each.
    """
    some = _spellings(df, key, text)
    n = some.groupBy("form", "form_2", "raw", "raw_2").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    n = n.groupBy("form", "form_2").agg(F.min("first").alias("class"), F.sum("n").alias("n_keys"), F.count("*").alias("n_spellings"))
    return some.join(n, ["form", "form_2"]).select(key, "class", "n_keys", "n_spellings")
