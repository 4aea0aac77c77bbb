import pyarrow as pa

from corvane.llm import leakage, nearpairs, quality
from corvane.llm import queries as llm

STEM = "A 40-year-old teacher has fever and a rash on the arm with pain in the joints for two weeks. Which of the following is the most likely diagnosis here?"


def kinds(texts, stems=STEM):
    """The first defect of each text, None where there is none."""
    stems = [stems] * len(texts) if isinstance(stems, str) else stems
    got = quality.flag_batch(pa.array(texts, pa.string()), pa.array(stems, pa.string()), pa.array([""] * len(texts)))
    return [next((d for d in quality.DEFECTS if got[d][i]), None) for i in range(len(texts))]


def test_long_texts_without_content_are_empty():
    texts = ["No explanation. " * 5, "Answer:" + " " * 60 + "B", "-" * 61, "N/A. " * 40, "**Explanation:**\n\n" * 9, ". " * 50, "Final Answer: (C)\n" * 12]
    assert kinds(texts) == ["empty"] * len(texts)
    sound = ["No explanation. " * 5 + "Gout is the cause of the pain.", "A bad decade.", "No explanation fits the rash and the fever of the teacher but Lyme disease does fit."]
    assert "empty" not in kinds(sound)


def test_answers_in_another_script_or_language():
    russian = "Мужчина 40 лет, лихорадка, сыпь. Вероятный диагноз?"
    texts = ["Диагноз: острый инфаркт миокарда.", "诊断是急性心肌梗死。", "Οξύ έμφραγμα του μυοκαρδίου.", "احتشاء عضلة القلب الحاد.", "Подагра. Final Answer: B", "Es ist die Gicht.", "La gotta è la causa del dolore, perché il ginocchio non è rosso e la febbre è alta."]
    assert kinds(texts) == ["language"] * len(texts)
    assert kinds(["Acute myocardial infarction."], russian) == ["language"]
    assert kinds(["Острый инфаркт миокарда."], russian) == [None]
    assert kinds(["TNF-α and IL-1β explain it.", "The Greek word ἀρθρῖτις means inflamed joint.", "Ampicillin plus gentamicin.", "β.", "50 %."]) == [None] * 5
    assert kinds(["Gout.", "Подагра."], "12 / 5?") == [None, None]


def test_substituted_overlaps(spark):
    """Every overlap of 20 words with one substitution, at any place of the stem."""
    stems, corpus = [], []
    for i in range(90):
        stem = [f"q{i}w{j}" for j in range(20 + i % 6)]
        at, n = i % 5 if i % 6 == 5 else 0, 20
        part = stem[at : at + n]
        part[1 + i % 18] = "changed"
        stems.append((f"s{i}", " ".join(stem)))
        corpus.append((f"c{i}", " ".join([f"before{i}"] * (i % 4) + part + [f"after{i}"] * 3)))
    got = leakage.leaked_passages(spark.createDataFrame(corpus, "id string, text string"), "id", "text", spark.createDataFrame(stems, "id string, text string"), "id", "text").collect()
    want = set()
    for s, q in stems:
        for c, t in corpus:
            a, b = q.split(), t.split()
            for x in range(len(a)):
                for y in range(len(b)):
                    e = [i for i in range(min(len(a) - x, len(b) - y)) if a[x + i] == b[y + i]]
                    if e and e[0] == 0 and e[-1] + 1 >= 20 and all(j - i <= 2 for i, j in zip(e, e[1:])):
                        want.add((s, c))
    assert len(want) == 90 and {(r["query_key"], r["corpus_key"]) for r in got} == want
    assert {(r["span"], r["same"]) for r in got} == {(20, 19)}


def test_keys_with_equal_low_bits_stay_apart(spark):
    """The hashes of k98686 and k3577747, and of k152665 and k1338274, are equal in their low 40 bits."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [("k98686", a), ("k3577747", b), ("x", a + " end"), ("y", b + " end"), ("k152665", c), ("k1338274", c + " end")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {tuple(r) for r in nearpairs.similar_pairs(df, "id", "text", 3, 0.6, 15).collect()}
    assert got == {("k98686", "x"), ("k3577747", "y"), ("k1338274", "k152665")}
    pairs, members = nearpairs.similar_texts(df, "id", "text", 3, 0.6, 15)
    assert pairs.count() == 3 and members.select("rep").distinct().count() == 6


def test_delimiters_left_open():
    broken = ["A) Gout is unlikely (because the joint is cool.", "The rash (1) is red.\n1) It itches (at night.", "It itches) and (burns.", "The code ```x = 1 fits.", "She said “it burns and left.", 'She said "it burns and left.', "The set {a, b is red [see 1]."]
    assert kinds(broken) == ["truncated"] * len(broken)
    sound = ["A) Gout fits (the joint is hot).\nB) Lyme fits.", "First, 1) it burns, 2) it itches (at night).", "Values in [0, 5) are low.", "„Es brennt“, she said.", "A 6\" cut.", "((a) and (b)) hold."]
    assert kinds(sound) == [None] * len(sound)


def test_small_classes_of_equal_passages(spark, tmp_path):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [("p1", a), ("p2", a.upper()), ("p3", a), ("p4", a + " end"), ("p5", a + " end"), ("p6", b)]
    spark.createDataFrame(rows, "passage_id string, text string").write.parquet(str(tmp_path / "passages.parquet"))
    got = {tuple(r) for r in llm.queries()["p4_groups"](spark, str(tmp_path)).select("passage_id", "class_id", "group_id", "links").collect()}
    assert got == {("p1", "p1", "p1", 1), ("p2", "p1", "p1", 1), ("p3", "p1", "p1", 1), ("p4", "p4", "p1", 1), ("p5", "p4", "p1", 1), ("p6", "p6", "p6", 0)}


def test_refusals_that_are_not_listed_word_by_word():
    texts = ["I'm sorry, I can't do that.", "I am afraid that we cannot go further here.", "As an AI model, I am not able to diagnose.", "Mi dispiace, non posso rispondere.", "抱歉，我无法提供医疗建议。"]
    got = [quality.flag_batch(pa.array([t]), pa.array([STEM]), pa.array([""]))["refusal"][0] for t in texts]
    assert all(got)
    assert kinds(["I can't say more than that the rash fits.", "The patient cannot walk, sorry to say."]) == [None, None]


def test_a_list_mark_at_the_end_breaks_off():
    texts = ["1. Gout is ruled out by the joint.\n2.", "Gout fits.\n- It burns.\n-", "A) Gout fits the fever.\nB)"]
    assert kinds(texts) == ["truncated"] * 3
    assert kinds(["The dose was raised to 2.", "1. Gout fits.\n2. Lyme fits."]) == [None, None]
