import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import kernels as K
from corvane.llm import mixing, quality
from corvane.llm.canonical import canonical, confusables, decode, encode, forms
from corvane.llm.leakage import aligned_runs
from corvane.llm.packing import Packing
from corvane.llm.quantiles import Summary, target_rank
from corvane.llm.splits import banded_distance

W = re.compile(r"[^\W_]+")
TEXTS = ["", None, "a b a b", "Ünï_çode β-cell 12mg x²", "w " * 5000, "  ", "İstanbul ΑΣ ΟΔΟΣ", "\x00a\x00"]


def test_words():
    h, off = K.words(TEXTS, chars=16)
    want = [W.findall((t or "").lower()) for t in TEXTS]
    assert np.diff(off).tolist() == [len(w) for w in want]
    seen = {}
    for w, x in zip(sum(want, []), h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s = K.sequence_hash(*K.words(["a b", "a  B!", "ab", "b a"]))
    assert s[0] == s[1] and len(set(s.tolist())) == 3


def test_jaccard():
    random.seed(1)
    a = [" ".join(random.choices("abcd", k=random.randint(0, 12))) for _ in range(200)]
    b = [" ".join(random.choices("abcd", k=random.randint(0, 12))) for _ in range(200)]
    j, _, _ = K.jaccard(a, b, 2)
    for x, y, got in zip(a, b, j, strict=True):
        s, t = ({tuple(z[i : i + 2]) for i in range(len(z) - 1)} for z in (x.split(), y.split()))
        assert abs(got - (len(s & t) / len(s | t) if s | t else 0)) < 1e-12


def test_aligned_runs():
    m = aligned_runs(["a b c d e f", "", "x y"], ["z a b c q e f", "a", None], 1)
    assert m["run"].tolist() == [3, 0, 0] and m["span"].tolist() == [6, 0, 0] and m["same"].tolist() == [5, 0, 0]


def test_banded_distance():
    random.seed(2)

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
        return d[-1]

    pairs = [([random.randint(0, 3) for _ in range(random.randint(0, 14))], [random.randint(0, 3) for _ in range(random.randint(0, 14))]) for _ in range(300)]
    band = np.array([random.randint(0, 8) for _ in pairs])
    got = banded_distance([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs], band)
    for (a, b), k, g in zip(pairs, band, got, strict=True):
        e = plain(a, b)
        assert g == (e if e <= k else -1), (a, b, k)
    assert len(banded_distance([], [], np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("k", [4, 64])
def test_quantiles(k):
    rng = np.random.default_rng(3)
    for v in (rng.normal(size=5000), np.zeros(777), np.arange(3.0), rng.integers(0, 5, 2000).astype(float)):
        parts = [Summary(k).add(p) for p in np.array_split(v, 7)]
        total = Summary.from_bytes(parts[0].to_bytes())
        for p in parts[1:]:
            total.merge(Summary.from_bytes(p.to_bytes()))
        assert total.n == len(v)
        s = np.sort(v)
        for q, x in zip([0, 0.01, 0.5, 0.99, 1], total.values([0, 0.01, 0.5, 0.99, 1]), strict=True):
            r = target_rank(q, len(v))
            assert np.searchsorted(s, x, "left") + 1 - total.error <= r <= np.searchsorted(s, x, "right") + total.error
        assert total.error <= len(v) * max(1, np.log2(len(v) / k) + 3) / k
    assert Summary().values([0.5]) == [None]


def test_packing():
    random.seed(3)
    for _ in range(200):
        c = random.choice([10, 37, 100])
        counts = Counter(random.randint(1, c) for _ in range(random.randint(0, 60)))
        p = Packing(dict(counts), c)
        load, seen = Counter(), Counter()
        for size, first, items, container, each in p.steps:
            assert first == seen[size]
            seen[size] += items
            for i in range(items):
                load[container + i // each] += size
        assert seen == counts and max(load.values(), default=0) <= c and sorted(load) == list(range(p.containers))
        assert p.containers <= 1.25 * -(-sum(s * n for s, n in counts.items()) // c) + 1 or max(counts) > c / 2
    with pytest.raises(ValueError):
        Packing({11: 1}, 10)


def test_subset_sum():
    random.seed(4)
    for _ in range(60):
        counts = Counter(random.randint(1, 30) for _ in range(random.randint(1, 8)))
        reach = {0}
        for s, n in counts.items():
            reach = {r + i * s for r in reach for i in range(n + 1)}
        b = random.randint(0, 120)
        t = mixing.subset_sum(dict(counts), b)
        assert all(n <= counts[s] for s, n in t.items()) and sum(s * n for s, n in t.items()) == max(r for r in reach if r <= b)
        total = sum(s * n for s, n in counts.items())
        t = mixing.fill(dict(counts), min(b, total))
        assert sum(s * n for s, n in t.items()) <= b
    big = {s: 5000 for s in range(40, 900, 7)}
    b = sum(s * n for s, n in big.items()) // 3
    assert sum(s * n for s, n in mixing.fill(big, b).items()) == b


def test_canonical():
    random.seed(5)
    pool = [chr(c) for r in ((0x20, 0x250), (0x300, 0x370), (0x400, 0x460), (0x1E00, 0x2000), (0xAC00, 0xAC60), (0x1100, 0x1200)) for c in range(*r)]
    for _ in range(3000):
        s = "".join(random.choices(pool, k=random.randint(0, 9)))
        c = canonical([s])[0]
        assert canonical([c]) == [c] and unicodedata.normalize("NFC", c) == c
        assert canonical([unicodedata.normalize("NFD", s)]) == [c]
    same = [("ｆｉｎｅ １", "fine 1"), ("ﬁne", "fine"), ("é", "é"), ("a​b­", "ab"), ("a b　c", "a b c"), ("сhеmо", "chemo"), ("µg", "μg"), ("a‑b", "a-b"), ("x\r\ny", "x\ny")]
    for a, b in same:
        assert canonical([a]) == canonical([b]), (a, b)
    for a, b in [("A", "a"), ("é", "e"), ("x²", "x2"), ("a,b", "a;b"), ("a\nb", "a b"), ("a  b", "a b")]:
        assert canonical([a]) != canonical([b])
    assert canonical([None, ""]) == [None, ""]


STEM = "A 40-year-old teacher has fever and a rash on the arm with pain in the joints for two weeks. Which of the following is the most likely diagnosis here?"
CASES = [
    (None, "empty"), ("", "empty"), ("​ \n", "empty"), ("Explanation:", "empty"), ("**Explanation**\n\n", "empty"), ("Final Answer: (C)", "empty"), ("B.", "empty"), ("n/a", "empty"), ("<empty>", "empty"), ("{}", "empty"),
    ("I'm sorry, but I am unable to help with that. Take care.", "refusal"), ("The arm is red. As a language system, my guidelines do not let me advise on this item.", "refusal"), ("Lo siento, no puedo ayudar con decisiones médicas.", "refusal"), ("Мне нельзя давать медицинские советы.", "refusal"),
    (STEM, "copied"), (STEM.upper(), "copied"), (STEM[:90], "copied"), ("Question: " + STEM + "\nA) Gout\nB) Lyme disease", "copied"),
    ("Die Befunde sprechen für eine Gicht, weil das Gelenk und der Arm nicht schmerzen und die Haut rot ist.", "language"),
    ("The tick bite explains the rash because the", "truncated"), ("The tick bite explains the rash [Truncated]", "truncated"), ("The tick bite (about…", "truncated"), ("The tick bite explains it.\nFinal Ans", "truncated"), ("The tick bite explains the ra", "truncated"),
]
SOUND = ["The tick bite explains the rash. [3]", "The findings point to Lyme disease.", "I cannot be fully certain, but Lyme disease is best. Final Answer: B", "Option B fits best. so the answer is B", "A clinician would decline the others and comment on gout only.", "Sorry for the length, yet gout remains the answer. (see passage [4])", '"fever and a rash on the arm" matters here. Ticks carry the germ that explains it all.']


def test_rules():
    texts = [t for t, _ in CASES] + SOUND
    got = quality.flag_batch(pa.array(texts, pa.string()), pa.array([STEM] * len(texts)), pa.array([" a Gout a Lyme disease"] * len(texts)))
    for i, t in enumerate(texts):
        kinds = [d for d in quality.DEFECTS if got[d][i]]
        assert (kinds[0] if kinds else None) == (CASES[i][1] if i < len(CASES) else None), (t, kinds)


def test_budgets_of_long_texts():
    """The largest sum there is, also where texts are longer than the program's usual stretch."""
    random.seed(11)
    cases = [({33000: 5, 50000: 5}, b) for b in (50000, 100000, 133000)]
    for _ in range(150):
        counts = {random.randint(1, random.choice((500, 60000))): random.randint(1, 4) for _ in range(random.randint(1, 5))}
        cases.append((counts, random.randint(0, sum(s * n for s, n in counts.items()))))
    for counts, b in cases:
        reach = {0}
        for s, n in counts.items():
            reach = {r + i * s for r in reach for i in range(n + 1) if r + i * s <= b}
        t = mixing.fill(counts, b)
        assert all(0 <= n <= counts[s] for s, n in t.items()) and sum(s * n for s, n in t.items()) == max(reach)


def test_code_points_of_arrow_texts():
    random.seed(12)
    pool = [chr(c) for c in (0, 9, 0x41, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFD, 0xFFFF, 0x10000, 0x10FFFF, 0x1F600)]
    texts = [None if random.random() < 0.1 else "".join(random.choices(pool, k=random.randint(0, 12))) for _ in range(500)]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for a in (whole, whole.slice(37, 200), whole.slice(500)):
            cp, counts = decode(a)
            want = [t or "" for t in a.to_pylist()]
            assert cp.tolist() == [ord(c) for t in want for c in t] and counts.tolist() == [len(t) for t in want]
            assert encode(cp, counts).to_pylist() == want
            assert encode(cp, counts, a.is_null()).to_pylist() == a.to_pylist()
    assert forms(pa.array(["a" * 600_000, None, "b", "", "c" * 600_000], pa.string())).to_pylist() == ["a" * 600_000, None, "b", "", "c" * 600_000]


def test_letters_of_further_scripts(spark):
    more = confusables(spark)
    assert canonical(["Ꭺꓐ ոս ⲞⲘ", "кот", "κοτ", "ᏤᏫ", "1Il|0O"], more)[:3] == ["AB nu OM", canonical(["κοτ"], more)[0], canonical(["κοτ"], more)[0]]
    assert canonical(["α a", "ε e", "1Il|0O", "عربي", "中文"], more) == ["α a", "ε e", "1Il|0O", "عربي", "中文"]
