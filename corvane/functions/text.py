"""Tokenisers and text functions as column expressions.

Every function takes columns (or plain values for parameters) and gives a column; null
text gives null unless stated. Sets of words come out sorted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() has it.
BLANK = r"[\s\x0b\p{Z}\x85\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]+"

# Words that carry no content, for coverage and memory search.
STOP_COVERAGE = ("the", "a", "an", "is", "of", "and", "in", "to", "for", "with", "patient", "which", "following")
# Words left out when passages are rescored.
STOP_RESCORE = ("the", "a", "an", "is", "of", "in", "to", "for", "with", "patient")
# Words left out of options.
STOP_OPTION = ("the", "a", "an", "of", "and")
# Phrases that mark a sentence as the question itself.
QUESTION_PHRASES = ("which of the following", "what is the", "most likely", "what should be", "which of these", "is the next step")
# Endings of drugs, conditions and organisms.
ENTITY_SUFFIXES = (
    "itis", "mycin", "micin", "cillin", "penem", "oxacin", "olol", "pine", "pril", "sartan", "azole", "nazole", "vir", "oma", "carcinoma", "tomy",
    "ectomy", "cocci", "bacillus", "statin", "mab", "nib", "tinib", "cycline", "thromycin", "dine", "tidine", "prazole", "sone", "solone", "zole",
)
# The known terms of the retriever (a) and of the router's tools (b).
ENTITY_TERMS_A = (
    "gonorrhoeae", "neisseria", "streptococcus", "staphylococcus", "chlamydia", "treponema", "syphilis", "cephalosporin", "fluoroquinolone", "aminoglycoside",
    "macrolide", "carbapenem", "sulfonamide", "tetracycline", "pneumoniae", "meningitidis", "aureus", "influenzae", "pseudomonas", "enterococcus",
    "gentamicin", "amikacin", "tobramycin", "vancomycin", "mycoplasma", "myocardial", "infarction", "hypertension", "diabetes", "hepatitis",
    "tuberculosis", "nephrotic", "nephritic", "syndrome", "leukemia", "lymphoma", "carcinoma", "arrhythmia", "sepsis", "endocarditis", "encephalitis",
)
ENTITY_TERMS_B = (
    "gonorrhoeae", "neisseria", "streptococcus", "staphylococcus", "chlamydia", "treponema", "syphilis", "cephalosporin", "fluoroquinolone", "aminoglycoside",
    "macrolide", "carbapenem", "sulfonamide", "tetracycline", "pneumoniae", "meningitidis", "aureus", "influenzae", "pseudomonas", "enterococcus",
    "gentamicin", "ceftriaxone", "myocardial", "infarction", "hypertension", "diabetes",
)
# Terms and what is added for them, in this order.
SYNONYMS = (
    ("diplococci", ("neisseria", "gonococcus")),
    ("neisseria", ("diplococci", "gonorrhoeae")),
    ("gonorrhoeae", ("diplococci", "neisseria")),
    ("joint fluid", ("synovial fluid", "joint aspirate")),
    ("synovial fluid", ("joint fluid",)),
    ("cell wall", ("peptidoglycan", "transpeptidase", "cross-linking")),
    ("ceftriaxone", ("cephalosporin", "third-generation")),
    ("gentamicin", ("aminoglycoside", "protein synthesis")),
    ("ciprofloxacin", ("fluoroquinolone", "dna gyrase")),
    ("trimethoprim", ("dihydrofolate reductase", "folate synthesis")),
    ("penicillin", ("beta-lactam", "transpeptidase")),
    ("syphilis", ("treponema", "pallidum", "chancre")),
    ("meningitis", ("cerebrospinal fluid", "csf", "nuchal rigidity")),
    ("csf", ("cerebrospinal fluid", "lumbar puncture")),
    ("lumbar puncture", ("csf", "spinal tap")),
    ("myocardial infarction", ("heart attack", "coronary occlusion", "troponin")),
    ("troponin", ("myocardial infarction", "ck-mb")),
    ("hypertension", ("blood pressure", "antihypertensive")),
    ("diabetes", ("glycated hemoglobin", "hba1c", "insulin")),
    ("gram-negative", ("endotoxin", "lipopolysaccharide", "lps")),
    ("gram-positive", ("peptidoglycan", "exotoxin")),
    ("mrsa", ("methicillin-resistant", "staphylococcus", "vancomycin")),
    ("tuberculosis", ("mycobacterium", "caseating granuloma", "rifampin")),
    ("chlamydia", ("azithromycin", "doxycycline", "inclusion bodies")),
    ("pneumonia", ("consolidation", "sputum", "pulmonary infiltrate")),
    ("lupus", ("sle", "anti-dsdna", "antinuclear antibody")),
    ("anemia", ("hemoglobin", "hematocrit", "ferritin", "microcytic")),
)


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_text(text), rf"^{BLANK}+|{BLANK}+$", "")


def blank_words(text: Column | str) -> Column:
    """Runs without white space, in order (TK1)."""
    return F.filter(F.split(_text(text), rf"{BLANK}+"), lambda w: w != "")


def word_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, in order (TK2)."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit(WORD), F.lit(0))


def word_set(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(word_tokens(text)))


def keywords(text: Column | str) -> Column:
    """Distinct words of more than three characters (TK3)."""
    plain = F.regexp_replace(F.lower(_text(text)), r"[^\p{L}\p{N}_\s\p{Z}]", " ")
    return F.array_sort(F.array_distinct(F.filter(blank_words(plain), lambda w: F.length(w) > 3)))


def sentences(text: Column | str) -> Column:
    """Parts after a full stop, exclamation or question mark and blanks (TK4)."""
    return F.split(_text(text), r"(?<=[.!?]) +")


def token_count(text: Column | str) -> Column:
    return F.size(blank_words(text))


def estimated_tokens(text: Column | str) -> Column:
    """Tokens guessed from words where a provider reports none."""
    return F.floor(token_count(text) * 4 / 3).cast("bigint")


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def text_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(word_set(a), word_set(b))


def entities(text: Column | str, terms: tuple[str, ...] = ENTITY_TERMS_A) -> Column:
    """Acronyms as written, and words with a known ending or from the list `terms`."""
    c = _text(text)
    acronyms = F.filter(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: w.rlike("^[A-Z]{2,}$"))
    ending = "(" + "|".join(ENTITY_SUFFIXES) + ")$"
    known = F.filter(word_tokens(c), lambda w: (F.length(w) >= 4) & (w.rlike(ending) | w.isin(*terms)))
    return F.array_sort(F.array_distinct(F.concat(acronyms, known)))


def _is_question(sentence: Column) -> Column:
    low = F.lower(sentence)
    found = F.lit(False)
    for p in QUESTION_PHRASES:
        found = found | F.contains(low, F.lit(p))
    return found


def prune_query(text: Column | str, need_entity: bool = True, terms: tuple[str, ...] = ENTITY_TERMS_A) -> Column:
    """Without the sentences that only ask, and, with `need_entity`, those that name no
    entity; the text as it was if nothing would be left."""
    c = _text(text)
    parts = sentences(stripped(c))

    def keep(s: Column) -> Column:
        return ~_is_question(s) & (F.size(entities(s, terms)) > 0) if need_entity else ~_is_question(s)

    left = F.filter(parts, keep)
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(c)


def expand_synonyms(text: Column | str) -> Column:
    """The text followed by what SYNONYMS has for it and it doesn't hold yet."""
    c = _text(text)
    low = F.lower(c)
    table = F.array(*[F.struct(F.lit(k).alias("k"), strings(v).alias("v")) for k, v in SYNONYMS])
    hits = F.filter(table, lambda e: F.contains(low, e["k"]))
    added = F.filter(F.flatten(F.transform(hits, lambda e: e["v"])), lambda s: ~F.contains(low, s))
    return F.when(F.size(added) > 0, F.concat(c, F.lit(" "), F.array_join(added, " "))).otherwise(c)


def compress_sentences(text: Column | str, words: Column) -> Column:
    """The sentences with one of `words`; the first two if none has; all if there are no words."""
    c = _text(text)
    parts = sentences(stripped(c))
    hit = F.filter(parts, lambda s: F.arrays_overlap(word_tokens(s), words))
    short = F.when(F.size(hit) > 0, F.array_join(hit, " ")).otherwise(F.array_join(F.slice(parts, 1, 2), " "))
    return F.when(F.size(words) > 0, short).otherwise(c)


def truncate_words(text: Column | str, n: int, mark: str = " [Truncated]") -> Column:
    """The first n words and `mark`; a text within the limit stays untouched."""
    w = blank_words(text)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(mark))).otherwise(_text(text))


def coverage(question: Column | str, passage: Column | str) -> Column:
    """Struct of the share of the question's words in the passage, whether it is enough
    (0.20), and up to three missing words in order."""
    return coverage_of(content_words(question), word_set(passage))


def content_words(question: Column | str) -> Column:
    """The words of a question that a passage should cover."""
    return F.array_except(word_set(question), strings(STOP_COVERAGE))


def coverage_of(q: Column, p: Column) -> Column:
    """The same of arrays of words, which a caller may make once for many rows."""
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q))
    missing = F.slice(F.array_sort(F.array_except(q, p)), 1, 3)
    return F.struct(share.alias("ratio"), F.coalesce(share >= 0.20, F.lit(True)).alias("is_sufficient"), missing.alias("missing"))


def cooccurrence(query: Column | str, passage: Column | str) -> Column:
    """The share of the query's entities that stand in the passage; 0.5 if it has none."""
    e = entities(query, ENTITY_TERMS_B)
    low = F.lower(_text(passage))
    return F.when(F.size(e) > 0, F.size(F.filter(e, lambda x: F.contains(low, F.lower(x)))) / F.size(e)).otherwise(F.lit(0.5))


def rescore(query: Column | str, passage: Column | str, score: Column) -> Column:
    """score + 2 Jaccard + 0.1 common words, over words that carry content."""
    q = F.array_except(word_set(query), strings(STOP_RESCORE))
    p = word_set(passage)
    common = F.size(F.array_intersect(q, p))
    return F.when(F.size(q) > 0, score + 2.0 * common / F.greatest(F.size(F.array_union(q, p)), F.lit(1)) + 0.1 * common).otherwise(score)


def overlap_weight(query: Column | str, text: Column | str) -> Column:
    """tf (1 + ln(1 + overlap)) over white-space words: share of the text's words that the query has."""
    q, t = blank_words(F.lower(_text(query))), blank_words(F.lower(_text(text)))
    hits = F.size(F.filter(t, lambda w: F.array_contains(q, w)))
    distinct = F.size(F.array_intersect(q, t))
    return F.when(F.size(t) > 0, hits / F.size(t) * (1 + F.log1p(distinct.cast("double")))).otherwise(F.lit(0.0))


#: The scorer of the synthetic benchmark goes by this name.
tfidf = overlap_weight
