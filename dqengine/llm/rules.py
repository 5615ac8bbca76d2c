"""Operator 9: quality rules with distribution divergence, natively in Spark.

Base rules count words, symbols, repeated lines and repeated five-word windows
of a text.  The verdict of the method compares two histograms of the text with
its language's reference by Jensen-Shannon distance (base 2, from 0 to 1):

* character classes (small letters, capitals, digits, blanks, punctuation,
  symbols, others), guarded by a least number of code points;
* common words of the language and all others, guarded by a least number of
  words.

References are grouped aggregates over all documents of a language: first over
those that pass the base rules, then over those of them that lie within the
limits of the first reference, so that junk does not bend what it is compared
with.  They have one row for each of a fixed set of languages, however large
the corpus is.

All of it is DataFrame and SQL expressions: texts are read once, their counts
(a few hundred bytes) are written once, nothing larger is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, staged

#: Frequent words of each language that has a reference.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "nicht", "ein"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
WORDS = len(next(iter(COMMON.values())))
CLASSES = ("small", "capital", "digit", "blank", "punctuation", "symbol", "other")
#: Limits of the distances, and the lengths from which they hold.
CLASS_LIMIT, CLASS_LEAST = 0.25, 250
WORD_LIMIT, WORD_LEAST = 0.26, 100
#: From this length on and below WORD_LEAST, texts beyond both limits are junk,
#: too; the word limit is divided by the root of the number of words.
SHORT_LEAST, SHORT_CLASS_LIMIT, SHORT_WORD_LIMIT = 20, 0.18, 2.25
_BLANK = r"[\\x20\\x09-\\x0D]+"


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts of every row, natively; no shuffle."""
    known = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("other")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), column_or_null(docs, lang, "string").alias("lang"))
    rows = rows.select("k", "t", known.alias("lang"))
    # An array of one element binds a value to a name inside an expression, so
    # that words are cut once and not once for each use.
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    words = f"filter(split(t, '{_BLANK}'), w -> w <> '')"
    windows = "if(size(h) < 5, array(), transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))"
    # places of windows that occur twice, then the words they cover together
    twice = bind("sort_array(transform(v, (x, i) -> struct(x AS x, i AS i)))", "s",
                 "transform(filter(transform(s, (e, n) -> struct(e.i AS i, (n > 0 AND s[greatest(n - 1, 0)].x = e.x) OR (n + 1 < size(s) AND s[least(n + 1, size(s) - 1)].x = e.x) AS again)), e -> e.again), e -> e.i)")
    covered = bind(f"sort_array({twice})", "p", "aggregate(transform(p, (x, n) -> if(n + 1 < size(p), least(5, p[least(n + 1, size(p) - 1)] - x), 5)), 0L, (a, x) -> a + x)")
    repeated = bind("transform(w, x -> xxhash64(x))", "h", bind(windows, "v", f"if(size(array_distinct(v)) = size(v), 0L, {covered})"))
    lines = bind(f"filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "x", "CAST(size(x) - size(array_distinct(x)) AS BIGINT)")
    common = ", ".join(f"CAST((octet_length(s) - octet_length(replace(s, concat(' ', c[{i}], ' '), ''))) / (octet_length(c[{i}]) + 2) AS BIGINT)" for i in range(WORDS))
    lists = "map(" + ", ".join(f"'{k}', array({', '.join(repr(w) for w in ws)})" for k, ws in COMMON.items()) + ")"
    histogram = bind("concat(' ', lower(array_join(w, '  ')), ' ')", "s", f"transform(array(element_at({lists}, lang)), c -> if(c IS NULL, array(), array({common})))[0]")
    per_words = bind(words, "w", f"struct(CAST(size(w) AS BIGINT) AS n_words, CAST(char_length(array_join(w, '')) AS BIGINT) AS word_chars, {repeated} AS n_repeat_words, {histogram} AS common)")
    rest = r"regexp_replace(t, '\\p{Ll}+', '')"
    count = lambda r, pattern: f"CAST(char_length(regexp_replace({r}, '[^{pattern}]+', '')) AS BIGINT)"
    classes = bind(rest, "r", "array(CAST(char_length(t) - char_length(r) AS BIGINT), " + ", ".join(count("r", p) for p in (
        r"\\p{Lu}", r"\\p{Nd}", r"\\s", r".,;:!?\\x27\"()-", r"#*$%&|<>")) + ")")
    rows = rows.select("k", "lang", F.expr(per_words).alias("n"), F.expr(lines).alias("n_dup_lines"), F.expr(classes).alias("c"), F.expr("CAST(char_length(t) AS BIGINT)").alias("chars"))
    return rows.select("k", "lang", "n.*", F.expr("c[5]").alias("n_symbols"), "n_dup_lines", "chars",
                       F.expr("concat(c, array(chars - aggregate(c, 0L, (a, x) -> a + x)))").alias("classes"),
                       F.expr("if(size(n.common) = 0, n.common, concat(n.common, array(n.n_words - aggregate(n.common, 0L, (a, x) -> a + x))))").alias("commons")).drop("common")


def failed_base() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of two histograms, null if either is empty."""
    total = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x)"
    part = "(p * if(p > 0, log2(2 * p / (p + q)), 0D) + q * if(q > 0, log2(2 * q / (p + q)), 0D)) / 2"
    terms = f"zip_with({counts}, {reference}, (a, b) -> transform(array(a / n[0]), p -> transform(array(b / n[1]), q -> if(p + q > 0, {part}, 0D))[0])[0])"
    return F.expr(f"transform(array(array({total(counts)}, {total(reference)})), n -> if(n[0] > 0 AND n[1] > 0, sqrt(greatest(aggregate({terms}, 0D, (s, x) -> s + x), 0D)), NULL))[0]")


def references(counts: DataFrame) -> DataFrame:
    """One row for each known language and one for all others together."""
    sums = lambda name, n: F.array(*(F.sum(F.try_element_at(name, F.lit(i + 1))).cast("double") for i in range(n)))
    return counts.groupBy("lang").agg(sums("classes", len(CLASSES)).alias("ref_classes"), F.transform(sums("commons", WORDS + 1), lambda x: F.coalesce(x, F.lit(0.0))).alias("ref_commons"))


def divergences(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts with the distances that the guards let stand, else null, and
    whether a short text lies beyond both of its limits."""
    with_ref = counts.join(F.broadcast(reference), "lang", "left")  # a row for each language of COMMON and one more
    return with_ref.select(*counts.columns,
                           F.when(F.col("chars") >= CLASS_LEAST, distance("classes", "ref_classes")).alias("class_distance"),
                           F.when((F.col("n_words") >= WORD_LEAST) & (F.size("commons") > 0), distance("commons", "ref_commons")).alias("word_distance"),
                           F.coalesce(F.when((F.col("n_words") >= SHORT_LEAST) & (F.col("n_words") < WORD_LEAST) & (F.size("commons") > 0),
                                             (distance("classes", "ref_classes") > SHORT_CLASS_LIMIT) & (distance("commons", "ref_commons") * F.sqrt("n_words") > SHORT_WORD_LIMIT)), F.lit(False)).alias("short_failed"))


def within_limits() -> Column:
    return F.coalesce(F.col("class_distance") <= CLASS_LIMIT, F.lit(True)) & F.coalesce(F.col("word_distance") <= WORD_LIMIT, F.lit(True))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", short: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key``, the base counts, ``base_failed``,
    the two distances (null where a guard or a missing reference forbids
    them) and ``kept``.  With ``short``, texts under ``WORD_LEAST`` words have
    to hold the limits for short texts as well.

    A null text counts as empty (no words: fails the base rules); a null or
    unknown language is compared with all such texts together, by character
    classes only; a null key stays null; repeated rows give repeated results;
    an empty table an empty one; other columns are never read.
    """
    counts = staged(counted(docs, key, text, lang))
    sound = counts.where(~failed_base())
    first = references(sound)
    reference = references(divergences(sound, first).where(within_limits()).select(*counts.columns))
    out = divergences(counts, reference).withColumn("base_failed", failed_base())
    return out.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & within_limits() & ~(F.lit(short) & F.col("short_failed"))).alias("kept"), "class_distance", "word_distance")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    from ..sources.tables import read_table
    return quality_rules(read_table(spark, sf_dir, "documents"), short=True)
