"""Quality rules: counts over whole texts and distribution divergence, in native expressions.

A document's verdict comes from two histograms, of character classes and of the language's common
words. Each is compared with a reference histogram of the document's language (the pooled counts of
all documents of that language that pass the base rules) by the Jensen-Shannon distance, the square
root of the divergence in bits, which lies between 0 and 1. Documents under a minimum length are
too short for a histogram to mean anything and get no divergence verdict.

The slot of all other words holds most of any text, so a text without common words is far below 1
from its reference. Its distance is the scale of the language: a document with fewer common words
than the reference is odd beyond a part of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, scratch_path

SPACE = r"[\x20\x09-\x0D]+"

# Frequent function words of the languages, as text, in natural order.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
# Lists for any other language.
OTHER_WORDS = ["the", "of", "and", "de", "la", "en", "der", "die", "und", "que", "el", "le"]
WORD_SLOTS = 12
CLASSES = ["lower", "space", "upper", "digit", "letter", "symbol", "other"]
SYMBOLS = "[#*$%&|<>]"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
#: Languages whose references are broadcast; with more, they are joined by an exchange.
MOST_LANGUAGES = 10_000


def class_counts(text: Column, spaces: Column) -> Column:
    """Array of counts by CLASSES; each pattern strips runs from what the last one left."""

    def pairs(left: Column, pattern: str, rest) -> Column:
        return let(F.regexp_replace(left, pattern, ""), lambda u: F.concat(F.array(F.char_length(left) - F.char_length(u)), rest(u)))

    rest = lambda t1: pairs(t1, "[A-Z]+", lambda t2: pairs(t2, "[0-9]+", lambda t3: pairs(t3, r"\p{L}+", lambda t4: pairs(t4, SYMBOLS + "+", lambda t5: F.array(F.char_length(t5))))))
    counted = pairs(text, r"[a-z\x20\x09-\x0D]+", rest)  # lower-case letters and spaces come as one count
    return let(counted, lambda c: F.concat(F.array(c[0] - spaces, spaces), F.slice(c, 2, 5)))


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside windows of eight words that the text holds twice or more.

    Windows are compared by 64-bit hashes of their words' hashes. Distinct hashes prove distinct
    windows; equal ones of different windows have odds of n * n / 2 ** 58 in a text of n words.
    """
    width = 8
    last = n - width

    def covered(at: Column) -> Column:  # at: sorted positions of repeated windows
        step = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.least(b - a, F.lit(width)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(
            F.aggregate(F.when(F.size(at) > 1, step).otherwise(F.array().cast("array<int>")), F.lit(width), lambda s, x: s + x)
        )

    def slow(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = F.zip_with(s, F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

        return let(let(pairs, repeated), covered)

    def doubled(h: Column, by: int) -> Column:  # hashes of runs twice as long, from hashes of runs of ``by``
        return F.zip_with(h, F.slice(h, by + 1, F.size(h) - by), lambda a, b: a.bitwiseXOR(F.shiftleft(b, by)))

    def hashes(ws: Column) -> Column:
        one = F.transform(ws, lambda w: F.xxhash64(w))
        eight = let(let(let(one, lambda h: doubled(h, 1)), lambda h: doubled(h, 2)), lambda h: doubled(h, 4))
        return let(eight, lambda h: F.slice(h, 1, F.size(h) - width + 1))  # the tail pairs with nothing

    def with_windows(ws: Column) -> Column:
        return let(
            hashes(ws),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h)),
        )

    return F.when(last < 1, F.lit(0)).otherwise(let(words, with_windows))


def _common_counts(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, then of all other words."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws} | set(OTHER_WORDS))

    def counts(found: Column, list_: list[str], n: Column) -> Column:
        each = [F.size(found) - F.size(F.array_remove(found, F.lit(w))) for w in list_]
        each += [F.lit(0)] * (WORD_SLOTS - len(list_))
        return let(F.array(*each), lambda c: F.concat(c, F.array(n - F.aggregate(c, F.lit(0), lambda s, x: s + x))))

    def of(found: Column, n: Column) -> Column:
        case = None
        for code, list_ in COMMON_WORDS.items():
            case = F.when(lang == code, counts(found, list_, n)) if case is None else case.when(lang == code, counts(found, list_, n))
        return case.otherwise(counts(found, OTHER_WORDS, n))

    return let(F.filter(words, lambda w: F.lower(w).isin(every)), lambda f: let(F.transform(f, F.lower), lambda low: of(low, F.size(words))))


def features(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by document: the ``keep`` columns, then the counted ones."""
    base = docs.select(*keep, F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = base.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    words = F.col("_words")
    split = split.withColumn("_word_chars", F.char_length(F.array_join(words, "")))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return split.select(
        *keep,
        "_lang",
        F.size(words).cast("long").alias("n_words"),
        F.col("_word_chars").cast("long").alias("word_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words, F.size(words)).cast("long").alias("n_repeat_words"),
        class_counts(F.col("_text"), F.char_length("_text") - F.col("_word_chars")).alias("_classes"),
        _common_counts(words, F.col("_lang")).alias("_common"),
    ).withColumn("n_symbols", F.col("_classes")[5].cast("long"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays of one length; 1.0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def of(tc: Column, tr: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda c, r: let(F.array(c / tc, r / tr), lambda x: part(x[0], (x[0] + x[1]) / 2) + part(x[1], (x[0] + x[1]) / 2)))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))

    return let(F.array(total(counts), total(reference)), lambda t: F.when((t[0] > 0) & (t[1] > 0), of(t[0], t[1])).otherwise(F.lit(1.0)))


def quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_chars: int = 200,
    max_class_distance: float = 0.30,
    min_word_count: int = 100,
    max_word_distance: float = 0.40,
    max_word_part: float = 0.80,
    min_common: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, counts, both distances, ``base_failed``, ``kept``.

    Base rules: fewer than ``min_words`` words, or over ``max_repeat_percent`` % of the words in
    repeated 8-word windows. The divergence verdict needs ``min_chars`` characters in words for
    the character classes and ``min_word_count`` words for the common words; below these the
    distance is still reported but not judged. Common words fail beyond ``max_word_distance``, or, if
    the reference has more of them, beyond ``max_word_part`` of the distance of a text that has none;
    the latter only where the reference lets a text of that length expect ``min_common`` of them. A null
    text counts as empty (base_failed); a null language is a language of its own; repeated rows are
    judged alike, each on its own; an empty table gives an empty result; a language none of whose
    documents pass has no reference, and its documents stay with the base rules. A kept column that is
    named like a result, or begins with an underscore, raises ``ValueError``; others are not read.

    Counted rows are written once, and the few references broadcast to them, so nothing large is exchanged.
    """
    if clash := [c for c in keep if c.lower() in RESULT or c.startswith("_")]:
        raise ValueError(f"columns in use: {sorted(clash)}")
    spark = docs.sparkSession
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    path = scratch_path(spark, "quality-counts")
    features(docs, text, lang, keep).withColumn("base_failed", failed).write.parquet(path)
    rated = spark.read.parquet(path)
    width = {"_classes": len(CLASSES), "_common": WORD_SLOTS + 1}
    sums = [F.array(*[F.sum(F.col(c)[i].cast("long")) for i in range(n)]).alias(f"{c}_ref") for c, n in width.items()]
    # one row per language, joined null-safely
    reference = rated.where(~F.col("base_failed")).groupBy(F.col("_lang").alias("_ref_lang")).agg(*sums)
    none = F.array(*[F.lit(0)] * WORD_SLOTS, F.lit(1))
    share = lambda c: 1 - F.try_divide(F.col(c)[WORD_SLOTS].cast("double"), F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x.cast("double")))
    reference = checkpoint(reference.withColumns({"_bare": js_distance(none, F.col("_common_ref")), "_usual": share("_common_ref")}))
    if reference.count() <= MOST_LANGUAGES:
        reference = F.broadcast(reference)
    judged = rated.join(reference, F.col("_lang").eqNullSafe(F.col("_ref_lang")), "left")
    distance = lambda c: F.when(F.col(f"{c}_ref").isNull(), F.lit(0.0)).otherwise(js_distance(F.col(c), F.col(f"{c}_ref")))
    expected = F.col("n_words") * F.col("_usual") >= min_common
    bare = expected & (share("_common") < F.col("_usual")) & (F.col("word_distance") > F.col("_bare") * max_word_part)
    odd = reduce(
        Column.__or__,
        [
            (F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_class_distance),
            (F.col("n_words") >= min_word_count) & ((F.col("word_distance") > max_word_distance) | F.coalesce(bare, F.lit(False))),
        ],
    )
    return (
        judged.withColumns({"class_distance": distance("_classes"), "word_distance": distance("_common")})
        .withColumn("kept", ~F.col("base_failed") & ~odd)
        .select(*keep, *RESULT)
    )
