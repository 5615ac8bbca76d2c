"""Operator 4: language identification by Bayesian evidence fusion.

For every text and language the log posterior adds up

* the text's likelihood: naive Bayes over hashed character trigrams, counted
  per language over all labelled documents.  Trigrams overlap and depend on
  each other, so n of them count as ``n * FULL / (n + FULL)``;
* the likelihood of the language that the markup declares, of the language
  code in the address's path and of the address suffix (top-level domain),
  each from its counts against the text's own verdicts, smoothed;
* the prior of the host: the verdicts of the host's other texts, smoothed
  towards the domain's, that towards the suffix's, that towards all.  Every
  level is one grouped aggregate (combined before the shuffle, so a host with
  a third of all pages is no burden) and a text's own verdict is taken out of
  its own prior.

Likelihoods are arrays with a place for each language; they are added and
normalised by SQL functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import text_buffers, text_slices
from .common import column_or_null, schema_of, staged, text_rows

#: Hash buckets of trigrams; trigrams a text counts as at most; languages a model may have.
BUCKETS, FULL, LANGUAGES = 1 << 13, 60.0, 256
#: Pseudo-counts: of trigram buckets, of declarations, of each level of host priors.
TRIGRAM, DECLARED, HOST = 0.5, 4.0, 8.0
#: Prior belief that a declaration or a path code names the text's language.
HONEST = 0.8


def trigrams(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's trigram counts over hashed buckets (bytes, small ASCII
    letters, whatever is no letter as one space)."""
    x = lower[data].astype(np.uint32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        t = x[a:b]
        t = t[np.append(True, (t[1:] != 32) | (t[:-1] != 32))] if len(t) else t
        if len(t) < 3:
            yield i, np.zeros(BUCKETS, np.int64)
            continue
        h = (t[:-2] << np.uint32(16) | t[1:-1] << np.uint32(8) | t[2:]) * np.uint32(2654435761)
        yield i, np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)


def _lower() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of every bucket and language) from labelled
    texts; languages are codes of two or three letters, the ``LANGUAGES`` most
    frequent.  Every labelled text counts; tasks send sums, and the driver sees
    ``BUCKETS`` numbers for each language."""
    code = F.lower(F.trim(F.col(f"`{lang}`")))
    rows = text_rows(docs, F.col(f"`{text}`").cast("string").alias("text"), F.when(code.rlike("^[a-z]{2,3}$"), code).alias("lang")).where("lang is not null and text is not null")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    names = sorted(r["lang"] for r in counted)
    place = {n: i for i, n in enumerate(names)}
    schema, arrow = schema_of("lang int, bucket int, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in (s for b in batches for s in text_slices(b)):
            langs = batch.column("lang").to_pylist()
            for i, c in trigrams(*text_buffers(batch.column("text")), _lower()):
                if langs[i] in place:
                    total[place[langs[i]]] += c
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[at, bucket])], schema=arrow)

    sums = rows.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.full((len(names), BUCKETS), TRIGRAM)
    np.add.at(total, (sums.column("lang").to_numpy(), sums.column("bucket").to_numpy()), sums.column("n").to_numpy())
    return names, np.log(total / total.sum(axis=1, keepdims=True)) if names else total


def page_evidence(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(k, text, declared, path, suffix, domain, host) of raw web pages, natively."""
    page = F.coalesce(F.col("page"), F.lit(""))
    pick = lambda column, pattern: F.nullif(F.lower(F.regexp_extract(column, pattern, 1)), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{html}`").cast("string").alias("page"), F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"))
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]{1,10};", " ")
    declared = F.coalesce(pick(page, r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b"),
                          pick(page, r"(?is)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([a-z]{2,3})\b"),
                          pick(page, r"(?is)<meta\b[^>]*og:locale[^>]*content\s*=\s*[\"']?([a-z]{2,3})\b"))
    host = pick(F.col("url"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
    rows = rows.select("k", text.alias("text"), declared.alias("declared"), pick(F.col("url"), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#-]|$)").alias("path"), host.alias("host"))
    return rows.select("*", F.nullif(F.regexp_extract("host", r"([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))


def document_evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The same of plain documents: the language column is their declaration,
    the source their host."""
    host = column_or_null(docs, source, "string")
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"), F.lower(column_or_null(docs, lang, "string")).alias("declared"),
                       F.lit(None).cast("string").alias("path"), host.alias("host"), F.lit(None).cast("string").alias("suffix"), host.alias("domain"))


def text_likelihoods(evidence: DataFrame, names: list[str], log_likelihood: np.ndarray) -> DataFrame:
    """Evidence without its text, with ``ll`` (tempered, best is 0), the
    text's own verdict ``own`` (probabilities) and ``grams``."""
    columns = [c for c in evidence.columns if c != "text"]
    spec = ", ".join(f"{c} {evidence.schema[c].dataType.simpleString()}" for c in columns)
    schema, arrow = schema_of(f"{spec}, ll array<double>, own array<double>, grams long")
    table = evidence.sparkSession.sparkContext.broadcast(log_likelihood.T.copy())  # at most BUCKETS x LANGUAGES numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lower = table.value, _lower()
        for batch in (s for b in batches for s in text_slices(b)):
            ll = np.zeros((batch.num_rows, len(names)))
            grams = np.zeros(batch.num_rows, np.int64)
            for i, c in trigrams(*text_buffers(batch.column("text")), lower):
                n = int(c.sum())
                grams[i] = n
                if n:
                    at = np.flatnonzero(c)
                    ll[i] = c[at] @ model[at] * FULL / (n + FULL)
            ll -= ll.max(axis=1, keepdims=True)
            own = np.exp(ll)
            own /= own.sum(axis=1, keepdims=True)
            out = [*(batch.column(c) for c in columns), pa.array(list(ll), arrow.field("ll").type), pa.array(list(own), arrow.field("own").type), pa.array(grams)]
            yield pa.RecordBatch.from_arrays(out, schema=arrow)

    return text_rows(evidence, *evidence.columns).mapInArrow(score, schema)


def _sums(n: int, column: str = "own") -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def _joined(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Left join on a column that may be null; keys that hold very many rows
    are left to adaptive skew handling."""
    return rows.join(table, on, "left")


def _smoothed(others: Column):
    return lambda s, p: (s + HOST * p) / (others + HOST)


def fused(scored: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``lang``, ``confidence`` and ``text_lang`` to scored evidence."""
    n = len(names)
    each = F.array(*map(F.lit, names))
    everything = F.array(*(F.lit(1.0 / n) for _ in names))
    # likelihoods of declarations: P(value | language) by the texts' own verdicts
    total = scored.agg(_sums(n).alias("all")).first()["all"]
    share = np.array([t or 0.0 for t in total]) + 1e-9
    prior = F.array(*(F.lit(float(x)) for x in (share + HOST / n) / (share.sum() + HOST)))
    rows = scored
    log_terms = []
    for c in ("declared", "path"):
        counts = rows.where(f"{c} is not null").groupBy(c).agg(_sums(n).alias("seen"))
        terms = F.array(*(F.log((F.col("seen")[i] + DECLARED * F.when(F.col(c) == name, F.lit(HONEST)).otherwise(F.lit((1 - HONEST) / max(n - 1, 1)))) / F.lit(float(share[i]) + DECLARED)) for i, name in enumerate(names)))
        rows = _joined(rows, counts.select(c, terms.alias(f"{c}_ll")), c)
        log_terms.append(f"{c}_ll")
    # host priors, from the widest level to the host; a text's own verdict is left out
    suffix = rows.where("suffix is not null").groupBy("suffix").agg(_sums(n).alias("suffix_sum"), F.count(F.lit(1)).alias("suffix_n"))
    domain = rows.where("domain is not null").groupBy("domain").agg(_sums(n).alias("domain_sum"), F.count(F.lit(1)).alias("domain_n"))
    host = rows.where("host is not null").groupBy("host").agg(_sums(n).alias("host_sum"), F.count(F.lit(1)).alias("host_n"))
    for level, table in (("suffix", suffix), ("domain", domain), ("host", host)):
        rows = _joined(rows, table, level)
    rows = rows.withColumn("p", prior)
    for level in ("suffix", "domain", "host"):
        others = F.col(f"{level}_n") - 1
        smoothed = F.zip_with(F.zip_with(f"{level}_sum", "own", lambda s, o: F.greatest(s - o, F.lit(0.0))), "p", _smoothed(others))
        rows = rows.withColumn("p", F.when(F.col(f"{level}_sum").isNull(), F.col("p")).otherwise(smoothed))
    score = F.zip_with("ll", "p", lambda a, b: a + F.log(F.greatest(b, F.lit(1e-12))))
    for c in log_terms:
        score = F.zip_with(score, F.coalesce(c, F.transform(everything, lambda _: F.lit(0.0))), lambda a, b: a + b)
    rows = rows.withColumn("score", score).withColumn("top", F.array_max("score"))
    return rows.select(*scored.columns, F.get(each, (F.array_position("score", F.col("top")) - 1).cast("int")).alias("lang"),
                       (1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))).alias("confidence"),
                       F.when(F.col("grams") > 0, F.get(each, (F.array_position("ll", F.array_max("ll")) - 1).cast("int"))).alias("text_lang"))


def languages(evidence: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``evidence`` (its columns but the text), with
    ``lang``, ``confidence`` (posterior probability), ``text_lang`` (by the
    text alone, null where it has no letters) and ``grams``.

    A null or empty text, a null host or declaration contribute nothing; with
    no evidence at all the verdict is the most frequent language.  Languages
    that are declared but not in the model contribute what their pages' texts
    say.  Null keys stay null; repeated rows give repeated results; an empty
    table an empty one; without labelled texts ``lang`` is null.
    """
    names, model = train(labelled, text, lang)
    keep = [c for c in evidence.columns if c != "text"]
    if not names:
        nothing = F.lit(None).cast("string")
        return evidence.select(*keep, nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_lang"), F.lit(0).cast("long").alias("grams"))
    scored = staged(text_likelihoods(evidence, names, model))
    return fused(scored, names).select(*keep, "lang", "confidence", "text_lang", "grams")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all web pages and all documents."""
    from ..sources.tables import read_table
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    one = page_evidence(pages).withColumns({"page_id": F.col("k").cast("long"), "doc_id": none}).drop("k")
    two = document_evidence(docs).withColumns({"page_id": none, "doc_id": F.col("k").cast("long")}).drop("k")
    found = languages(one.unionByName(two), docs)
    return found.select("page_id", "doc_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "path", "suffix", "host")
