"""Defects of question-answer pairs by ordered rules over Arrow batches.

The regular expressions run in Arrow's C++ engine over whole columns; words, copied
runs and languages are counted on word hashes. Every rule that a text triggers is
reported; the order of DEFECTS decides which one stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernels import U, mix, shingles, words

#: In the order in which they take precedence.
DEFECTS = ("empty", "copied", "refusal", "language", "truncated")

# The words by which languages are told apart, most frequent ones.
FUNCTION_WORDS = {
    "en": "the of and in is a an with to for not by that are from but may one has on while this which as at be was or it so than before after because if nor both i do my you will no",
    "es": "el la los las de que y en con por una un se al no del su más para es lo como si según pero antes tanto sea baja porque cuando después también entre desde días mi",
    "fr": "le la les de des que et en dans une un est pour par ne pas du au se ce qui avec si ni car il je à sur mais avant plus depuis lorsque comme vers également jours n l",
    "de": "der die das und ist von mit den dem nicht ein eine einer bei wird zu sich im auf aus seit wenn weil als für durch sowohl auch weder noch unter tagen später ich keine über werden",
    "it": "il lo la gli i le di che e in con per un una è non del della dei delle al alla da dal nel nella si come più ma anche sono o se dopo prima perché quando tra senza",
    "pt": "o a os as de que e em com por um uma é não do da dos das no na ao se mais para como mas também são ou após antes porque quando entre sem pelo pela",
    "nl": "de het een en van in is niet op te met voor aan bij dat die door ook als maar of om uit naar zijn wordt werd geen tussen omdat wanneer zonder",
    "ru": "и в на не при с по что для из от у как к до о после его за если или но так это то где ни также когда через дней после того я",
}
# The phrases by which an answer is declined.
REFUSALS = {
    "en": r"\b(?:i(?:'m| am) (?:unable|not able|not permitted|not allowed|not in a position) to\b"
    r"|i (?:can't|cannot|can not|won't|will not|may not|must decline to|refuse to|do not wish to|don't wish to|decline to|must refuse to|have to decline to) (?:(?:be able to|really) )?(?:help|assist|advise|comment|respond|weigh|give|take a position|answer|discuss|provide|offer|choose|engage|go into|speak|say (?:anything|whether|what|which|if))\b"
    r"|\b(?:i(?:'m| am)|we(?:'re| are)) (?:very |so |really |truly )?(?:sorry|afraid)\b[^.!?]{0,40}\b(?:i|we) (?:can't|cannot|can not|won't|will not|(?:am|are) (?:unable|not able)|must decline)\b"
    r"|\bas an ai\b[^.!?]{0,60}\b(?:can't|cannot|can not|unable|not able|not allowed)\b"
    r"|i(?:'d| would) (?:rather|prefer) not\b|i(?:'d| would) prefer not to\b|i(?:'ll| will| must| need to|'d have to| will have to) pass on|(?:nobody|no one) should rely on (?:me|my)\b|(?:outside|beyond) (?:of )?(?:what i (?:may|can|am allowed)|my (?:role|scope|remit|competence|abilities))"
    r"|(?:has|have|needs?|ought) to be left to (?:others|(?:a|your|the) (?:doctor|physician|clinician|professional|specialist|expert))"
    r"|nothing i am (?:allowed|permitted) to say|my (?:guidelines|policies|rules|instructions) (?:do not|don't|forbid|prohibit|prevent)(?: (?:let|allow|permit))?|unsafe for me to|please direct [^.]{1,60} elsewhere|no answer to [^.]{1,60} will be given|let(?:'s| us) not (?:go into|get into|discuss|address)|against my (?:guidelines|policy))",
    "es": r"no puedo (?:ayudar|responder|contestar|opinar|dar)|no estoy autorizad|no me es posible|no me está permitid|queda fuera de lo que puedo|debo abstenerme|prefiero no (?:elegir|responder|contestar|opinar)|me niego a",
    "fr": r"je ne (?:peux|puis) pas (?:répondre|aider|donner|vous|me)|il ne m'est pas (?:permis|possible)|je préfère ne pas|je préfère m'abstenir|je refuse de|je dois m'abstenir|dépasse (?:mon rôle|ce que je)|je ne suis pas (?:autorisé|en mesure|habilité)|je m'abstiens",
    "de": r"dabei kann ich nicht|kann ich (?:leider )?nicht (?:helfen|beantworten|antworten|weiterhelfen)|darf ich keine|ich darf (?:dazu |hierzu )?(?:keine|nicht)|möchte (?:ich )?(?:hier )?keine|ich lehne es ab|muss ich ablehnen|ich muss (?:leider )?ablehnen|ich enthalte mich|ich bin nicht (?:befugt|berechtigt)",
    "ru": r"не могу (?:помочь|ответить|отвечать|давать|дать|обсуждать)|вынужден[а]? отказаться|мне нельзя|я не вправе|не имею права|предпочитаю не|воздержусь|отказываюсь отвечать|не уполномочен",
    "it": r"non posso (?:aiutar|rispondere|fornire|dare|consigliar|esprimer)|non sono autorizzat|non mi è (?:permesso|possibile)|preferisco non|mi rifiuto di|devo astenermi",
    "pt": r"não posso (?:ajudar|responder|fornecer|dar|opinar|aconselhar)|não estou autorizad|não me é (?:permitido|possível)|prefiro não|(?:me recuso|recuso-me) a|devo abster-me",
    "nl": r"kan ik (?:helaas )?niet (?:helpen|beantwoorden|antwoorden)|ik kan (?:u |je |hier |daar )?(?:helaas )?(?:niet|geen) (?:helpen|antwoord|advies)|ik mag (?:hier |daar )?(?:geen|niet)|ik weiger|ik moet weigeren",
    "zh": r"我(?:不能|无法|不便|拒绝)(?:回答|提供|协助|帮助|给出|评论)|(?:抱歉|对不起)[,，]?我(?:不能|无法)",
    "ja": r"お答え(?:できません|することはできません|いたしかねます)|申し訳(?:ありません|ございません)が",
    "ar": r"لا (?:أستطيع|يمكنني) (?:المساعدة|مساعدتك|الإجابة|تقديم)|أعتذر عن",
}
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿"
#: A text that holds nothing but labels, placeholders or an answer line, once it is reduced to lower-case words.
_EMPTY = r"^(?:(?:explanation|rationale|reasoning|reason|justification|analysis|response|output|answer|text|none|null|nan|nil|na|n a|n\.a|empty|no output|no answer|no explanation|no response|not available|undefined|missing|tbd|todo|(?:the )?(?:final |correct |best )?(?:answer|choice|option)(?: is)? [a-j]|[a-j])(?: |$))*$"
# The scripts that are told apart. A word is a run of at least two letters; where words aren't parted, two characters count as one.
SCRIPTS = (
    *(rf"\p{{{x}}}{{2,}}" for x in "Latin Cyrillic Greek Arabic Hebrew Hangul Devanagari Bengali Tamil Telugu Gujarati Gurmukhi Kannada Malayalam Sinhala Armenian Georgian Ethiopic".split()),
    r"[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}",
    *(rf"\p{{{x}}}{{1,2}}" for x in "Thai Lao Khmer Myanmar Tibetan".split()),
)
#: A letter of another script than the first one.
_BEYOND = r"[^\PL\p{Latin}]"
#: Closings after a finished text.
_CLOSING = r"(?i)(?:\s*(?:\[\d+\]|\(see passage \[\d+\]\)|(?:\*\*)?(?:the )?(?:final |correct )?(?:answer|choice)(?:\*\*)?(?: is)?\s*:?\s*\(?[a-j]\)?\.?|so the answer is \(?[a-j]\)?\.?|final choice \(?[a-j]\)?\.?))+\s*$"
_DELIMITERS = ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}"), ("“", "”"), ("«", "»"))
_TURNED = {"“": "„", "«": "^[^«»]*»"}
#: Labels and list marks at the start of a line; ranges that are open at one end.
_MARKS = r"(?m)^[ \t]*\(?(?:[A-Za-z]|\d{1,3})\)"
_INTERVAL = r"[\[(]\s*[-−]?[\d.∞]+\s*[,;]\s*[-−]?[\d.∞]+\s*[\])]"
_ENDS = r"[.!?。！？…][\"'”’»)\]*]*$"
_CUT = r"(?i)(?:…|\.\.\.|\[trunc[a-z]*\]?|\[\.\.\.\]|\bfinal an[a-z]*|\bfinal answer\s*:?|\banswer\s*:|\bfinal|(?:^|\s)[\"“«']|(?:^|\n)[ \t]*(?:\(?\d{1,3}[.)]|[-*•]|\(?[a-j]\)))\s*$"


_words: tuple[np.ndarray, np.ndarray] | None = None


def _hashes(text: str) -> np.ndarray:
    return np.unique(words([text])[0])


def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all function words, in order, and the languages of each as bits."""
    global _words
    if _words is None:
        h = [_hashes(w) for w in FUNCTION_WORDS.values()]
        known = np.unique(np.concatenate(h))
        _words = known, sum(np.isin(known, x).astype(np.int64) << k for k, x in enumerate(h))
    return _words


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of `x` whose values are in the sorted array `known`."""
    table = np.zeros(1 << 21, bool)
    table[(known >> U(43)).astype(np.int64)] = True
    some = np.flatnonzero(table[(x >> U(43)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, x[some]), len(known) - 1)
    return some[known[at] == x[some]]


def _languages(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with most function words of each row (-1 if there is none), and all counts."""
    n = len(off) - 1
    known, langs = _lexicon()
    at = _among(known, h)
    bits, row = langs[np.searchsorted(known, h[at])], np.searchsorted(off, at, side="right") - 1
    counts = np.stack([np.bincount(row[(bits >> k) & 1 > 0], minlength=n) for k in range(len(FUNCTION_WORDS))], axis=1)
    best = counts.argmax(axis=1)
    return np.where(counts.max(axis=1) > 0, best, -1), counts


def _unclosed(texts: pa.Array) -> np.ndarray:
    """Whether a delimiter of some kind is left open. Closing ones without an opening one,
    such as those of list marks, count for nothing."""
    out = np.zeros(len(texts), bool)
    some = np.flatnonzero(pc.match_substring_regex(texts, r"[(\[{\"“«]|```").to_numpy(zero_copy_only=False))
    if not len(some):
        return out
    x = pc.replace_substring_regex(pc.replace_substring_regex(texts.take(pa.array(some)), _MARKS, ""), _INTERVAL, "")
    open_ = pc.not_equal(pc.bit_wise_and(pc.count_substring(x, "```"), 1), 0)
    # A quote mark after a number may stand for inches, or may close: only a count odd either way tells.
    for y in (x, pc.replace_substring_regex(x, r"\d ?\"", "")):
        odd = pc.not_equal(pc.bit_wise_and(pc.count_substring(y, '"'), 1), 0)
        quoted = odd if y is x else pc.and_(quoted, odd)
    open_ = pc.or_(open_, quoted)
    # What is quoted may be a part of a bracket.
    x = pc.replace_substring_regex(x, r"\"[^\"]*\"|“[^“”]*”", "")
    for left, right in _DELIMITERS:
        y, pair = x, rf"{left}[^{left}{right}]*{right}"
        while pc.any(pc.match_substring_regex(y, pair)).as_py():
            y = pc.replace_substring_regex(y, pair, "")
        found = pc.match_substring_regex(y, left)
        if left in _TURNED:
            # German closes with what other languages open with.
            found = pc.and_(found, pc.invert(pc.match_substring_regex(x, _TURNED[left])))
        open_ = pc.or_(open_, found)
    out[some] = open_.to_numpy(zero_copy_only=False)
    return out


def _scripts(texts: pa.Array) -> np.ndarray:
    """The script of more than half of each text's words, -1 if there is none."""
    counts = np.stack([pc.count_substring_regex(texts, s).to_numpy(zero_copy_only=False) for s in SCRIPTS], axis=1)
    return np.where(2 * counts.max(axis=1, initial=0) > counts.sum(axis=1), counts.argmax(axis=1), -1)


def _other_script(answers: pa.Array, stems: pa.Array) -> np.ndarray:
    """Whether most words of an answer are in another script than most words of its stem."""
    out = np.zeros(len(answers), bool)
    some = np.flatnonzero(pc.or_(pc.match_substring_regex(answers, _BEYOND), pc.match_substring_regex(stems, _BEYOND)).to_numpy(zero_copy_only=False))
    if len(some):
        a, s = _scripts(answers.take(pa.array(some))), _scripts(stems.take(pa.array(some)))
        out[some] = (a >= 0) & (s >= 0) & (a != s)
    return out


def _copied(h: np.ndarray, off: np.ndarray, hs: np.ndarray, os_: np.ndarray, options: list[str | None]) -> np.ndarray:
    """The share of a text's words that lie in runs of three words of the stem, or in an option."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    covered = np.zeros(len(h) + 3, np.int64)
    ho, oo = words(options)
    for width, (hh, of) in ((3, (hs, os_)), (2, (ho, oo)), (1, (ho, oo))):
        x, r, pos = shingles(h, off, width)
        y, s, _ = shingles(hh, of, width)
        if width == 1:
            # Options are parted by single letters; a one-word option is a word between two of them.
            single = _hashes("a b c d e f g h i j")
            mark = np.concatenate(([True], np.isin(hh, single), [True]))
            y, s = y[mark[:-2] & mark[2:] & ~mark[1:-1]], s[mark[:-2] & mark[2:] & ~mark[1:-1]]
        salt = lambda v, q: mix(v + q.astype(U) * U(0xD6E8FEB86659FD93))
        known = np.sort(salt(y, s))
        if not len(known) or not len(x):
            continue
        p = pos[_among(known, salt(x, r))]
        np.add.at(covered, p, 1)
        np.add.at(covered, p + width, -1)
    inside = np.cumsum(covered)[: len(h)] > 0
    # A label of an option counts neither way.
    labels = np.zeros(len(h), bool)
    labels[_among(np.sort(_hashes("a b c d e f g h i j")), h)] = True
    labels &= ~inside
    base = np.bincount(row[~labels], minlength=n)
    return np.divide(np.bincount(row[inside], minlength=n), base, out=np.zeros(n), where=base > 0)


def flag_batch(answers: pa.Array, stems: pa.Array, options: pa.Array, least: float = 0.75) -> dict[str, np.ndarray]:
    """For each defect, which rows of a batch trigger its rule."""
    answers = pc.fill_null(answers.cast(pa.large_string()), "")
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(answers, f"[{_INVISIBLE}]", ""))
    # The whole text as words: marks, stops that end a word, and blanks become one blank.
    bare = pc.replace_substring_regex(pc.utf8_lower(plain), r"[^\pL\pN.]+", " ")
    bare = pc.replace_substring_regex(bare, r"(?:^|[. ])[. ]*(?: |$)|(?:^| )[. ]+", " ")
    empty = pc.match_substring_regex(pc.utf8_trim(bare, " ."), _EMPTY)
    refusal = pc.match_substring_regex(pc.replace_substring(plain, "’", "'"), "(?i)" + "|".join(REFUSALS.values()))
    body = pc.utf8_trim_whitespace(pc.replace_substring_regex(plain, _CLOSING, ""))
    ended = pc.match_substring_regex(body, _ENDS)
    cut = pc.match_substring_regex(plain, _CUT)
    opened = pa.array(_unclosed(plain))
    truncated = pc.or_(pc.or_(pc.invert(ended), cut), opened)
    h, off = words(plain.to_pylist())
    hs, os_ = words(stems.to_pylist())
    lang, counts = _languages(h, off)
    stem_lang, stem_counts = _languages(hs, os_)
    rows = np.arange(len(lang))
    # Two words tell the language of a short answer that holds none of the stem's language.
    least_words = np.where((np.diff(off) <= 12) & (counts[rows, stem_lang] == 0), 2, 3)
    other = (lang >= 0) & (stem_lang >= 0) & (lang != stem_lang) & (counts.max(axis=1, initial=0) >= least_words) & (counts[rows, lang] > counts[rows, stem_lang] + 1)
    other |= _other_script(body, pc.fill_null(stems.cast(pa.large_string()), ""))
    as_np = lambda a: np.asarray(a.to_numpy(zero_copy_only=False), bool)
    empty = as_np(empty)
    out = {"empty": empty, "copied": ~empty & (_copied(h, off, hs, os_, options.to_pylist()) >= least), "refusal": ~empty & as_np(refusal), "language": ~empty & other, "truncated": ~empty & as_np(truncated)}
    return out


def _flag(key: list[str], least: float):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                got = flag_batch(b.column("answer_"), b.column("stem_"), b.column("options_"), least)
                hits = np.vstack([got[d] for d in DEFECTS])
                use = np.flatnonzero(hits.any(axis=0))
                lists = [[d for d, v in zip(DEFECTS, hits[:, i], strict=True) if v] for i in use]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(use)) for k in key), pa.array(lists, pa.list_(pa.string()))], names=[*key, "defects"])

    return flag


#: Most bytes of stems and options that may be sent to all executors; beyond it the join is shuffled.
MOST_STEM_BYTES = 48 << 20
#: Parts that each question's answers are dealt to when the join is shuffled, so that a question
#: with a large share of all answers isn't one task's.
SALTS = 16


def defective_pairs(answers: DataFrame, key: str, answer: str, link: str, questions: DataFrame, question_key: str, stem: str, options: str | None = None, least: float = 0.75) -> DataFrame:
    """Rows (key, defects) of the answers that trigger a rule, each key once.

    `defects` holds every triggered kind in the order of DEFECTS. A key delivered twice
    has the kinds of all its deliveries. An answer without a known question is judged by
    the rules that need none. Null answers are empty, null keys are left out. A null
    stem has no language and can't be copied.
    """
    opt = F.lit("") if options is None else F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.lit(" a "), e["value"])), " a "), F.lit(""))
    q = questions.where(F.col(question_key).isNotNull()).groupBy(F.col(question_key).alias("link_")).agg(F.max(F.struct(F.coalesce(F.col(stem), F.lit("")).alias("s"), opt.alias("o"))).alias("m"))
    q = q.select("link_", F.col("m.s").alias("stem_"), F.col("m.o").alias("options_"))
    a = answers.where(F.col(key).isNotNull()).select(F.col(key), F.col(link).alias("link_"), F.col(answer).cast("string").alias("answer_"))
    bytes_ = q.agg(F.sum(F.octet_length("stem_") + F.octet_length("options_") + F.octet_length(F.col("link_").cast("string")) + 64)).first()[0] or 0
    if bytes_ <= MOST_STEM_BYTES:
        joined = a.join(F.broadcast(q), "link_", "left")
    else:
        # The salt comes from the answer's key, so a task that runs again deals the same way.
        dealt = a.withColumn("salt_", F.pmod(F.xxhash64(key, "answer_"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(q.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["link_", "salt_"], "left")
    joined = joined.select(key, "answer_", F.coalesce("stem_", F.lit("")).alias("stem_"), F.coalesce("options_", F.lit("")).alias("options_"))
    kind = dict(a.dtypes)[key]
    found = joined.mapInArrow(_flag([key], least), f"`{key}` {kind}, defects array<string>")
    order = F.array(*[F.lit(d) for d in DEFECTS])
    return found.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("defects"))).alias("d")).select(key, F.filter(order, lambda x: F.array_contains(F.col("d"), x)).alias("defects"))


def first_defect(found: DataFrame, key: str) -> DataFrame:
    """Rows (key, defect) with the kind that takes precedence."""
    return found.select(key, F.element_at("defects", 1).alias("defect"))
