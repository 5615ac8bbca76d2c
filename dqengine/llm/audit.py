"""Operator 11: how filters interact, over all orders of applying them.

Each document has a mask: bit k says that it fails filter k.  What any order of
the filters keeps, removes and finds removed already depends on the mask alone,
so documents are counted by (part, mask) first, at most 32 cells a part for five
filters.  Every cell then folds over the array of all orders, with ``transform``
over the orders and ``aggregate`` over the steps of each: one weighted struct
for each order and step (600 for five filters).  A part's cells are merged by
elementwise sums of their structs.  The orders are one array literal, which
travels to the tasks with the plan; it depends on the number of filters only.

A filter's Shapley value (times the number of orders) is what it removes, summed
over all orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import schema_of, text_rows

MEASURES = "n_words long, n_distinct long, n_upper long, n_chars long, n_marks long, digest binary"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Symbols that filter D looks for.
MARKS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(k, part, n_words, n_distinct, n_upper, n_chars, n_marks, digest) of every
    row: words between ASCII blanks, letters A-Z, code points, symbols of
    ``MARKS``, SHA-256 of the text's UTF-8.

    A null text counts as empty, a null part as the empty string, and so does a
    table without the column ``part``; null keys stay null, repeated rows
    repeat, other columns are never read.  Texts of any length are taken whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, part string, {MEASURES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b)):
            out = []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                t = t or b""
                words = t.split()
                others = [len(t.translate(None, c)) for c in (_UPPER, _CONTINUATION, MARKS)]
                out.append((len(words), len(set(words)), len(t) - others[0], others[1], len(t) - others[2], hashlib.sha256(t).digest()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("part"), *columns], schema=arrow)

    of = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")) if part in docs.columns else F.lit("")
    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), of.alias("part"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def mask_of(failures: Sequence[Column]) -> Column:
    """Bit k is set where condition k holds (a null condition does not)."""
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures)]
    return sum(bits[1:], bits[0])


def mask_cells(rows: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and how many
    of them a label calls good or toxic.

    ``rows`` are (k, part, mask, digest); ``copy_bit`` is added to the mask of a
    row if a row with a smaller key has its digest.  Of several labels of a key
    any counts.  A null key has no label and neither is nor has a copy.

    No group is gathered: rows are counted by (digest, part, mask, label, key),
    then by the same without the key, with the least key and its count; only
    these few rows a digest meet in a window.  Null keys are spread by digest.
    """
    salt = F.when(F.col("k").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("k"))
                   .agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
                   .withColumn("salt", F.lit(0).cast("long")))
    marked = (rows.withColumn("salt", salt).join(known, ["k", "salt"], "left")
                  .select("k", "part", "mask", "digest", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))
    kinds = ["digest", "mask", "part", "good", "toxic"]
    by_key = marked.groupBy(*kinds, "k").agg(F.count(F.lit(1)).alias("n"))
    by_kind = by_key.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("k").isNotNull(), F.struct("k", "n"))).alias("first"),
        F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("keyless"))
    least = F.min("first.k").over(Window.partitionBy("digest"))
    by_kind = by_kind.withColumn("least", least)
    single = F.col("keyless") + F.when(F.col("first.k") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.array(F.struct(F.col("mask").alias("mask"), single.alias("n")),
                     F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - single).alias("n")))
    flat = by_kind.select("part", "good", "toxic", F.explode(copies).alias("c")).where("c.n > 0")
    n = F.col("c.n")
    return flat.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


#: What is counted at each step of an order.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley) for every part, order and step.

    ``cells`` are (part, mask, n, good, toxic); bit k of a mask belongs to
    ``letters[k]``.  Cells of the same part and mask add up; a part has rows as
    soon as it has a cell; an empty table gives an empty result.
    """
    width = len(letters)
    orders = list(permutations(range(width)))
    array_of_orders = F.from_json(F.lit(str([list(o) for o in orders])), "array<array<int>>")  # folded to one literal
    zero = F.lit(0).cast("long")

    def fails(f: Column) -> Column:
        return F.get("failing", f)

    def step(state: Column, f: Column) -> Column:
        here = fails(f) & ~state["gone"]
        gone = state["gone"] | fails(f)
        row = F.struct(*[F.when(c, F.col(w)).otherwise(zero).alias(name) for name, c, w in (
            ("kept", ~gone, "n"), ("removed", here, "n"), ("redundant", fails(f) & state["gone"], "n"),
            ("unique_fails", fails(f) & F.col("single"), "n"), ("good_lost", here, "good"), ("toxic_lost", here, "toxic"))])
        return F.struct(gone.alias("gone"), F.concat(state["rows"], F.array(row)).alias("rows"))

    shape = f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(shape).alias("rows"))
    folded = F.flatten(F.transform(array_of_orders, lambda order: F.aggregate(order, start, step, lambda s: s["rows"])))
    weighted = (cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
                     .withColumn("failing", F.array(*[F.col("mask").bitwiseAND(1 << k) != 0 for k in range(width)]))
                     .withColumn("single", F.bit_count("mask") == 1)
                     .select("part", folded.alias("rows")))
    # 32 cells a part at most, each of the same length
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))
    none = F.transform(F.sequence(F.lit(1), F.lit(len(orders) * width)), lambda _: F.struct(*[zero.alias(c) for c in COUNTS]))
    merged = weighted.groupBy("part").agg(F.collect_list("rows").alias("all")).select(
        "part", F.aggregate("all", none, add).alias("rows"))
    names = F.split(F.lit(" ".join("".join(letters[f] for f in o) for o in orders)), " ")
    each = merged.select("part", F.posexplode("rows").alias("at", "r"))
    flat = each.select("part", F.get(names, F.floor(F.col("at") / width).cast("int")).alias("filter_order"),
                       (F.col("at") % width + 1).cast("int").alias("step"), *[F.col(f"r.{c}").alias(c) for c in COUNTS])
    flat = flat.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # a part's rows are in one place already, 120 of them for each of five filters
    return flat.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by source."""
    from ..sources.tables import read_table
    rows = text_measures(read_table(spark, sf_dir, "documents"))
    short = F.col("n_words") < 200
    repetitive = 100 * F.col("n_distinct") < 50 * F.col("n_words")
    loud = 100 * F.col("n_upper") > 2 * F.col("n_chars")
    masked = rows.select("k", "part", "digest", mask_of([short, repetitive, loud, F.col("n_marks") > 0]).alias("mask"))
    return audit(mask_cells(masked, read_table(spark, sf_dir, "labels"), copy_bit=16), "ABCDE")


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM words LEFT JOIN known USING (doc_id)),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o, a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, filter_order, unnest(range(1, 6)) AS step FROM orders),
places AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, o[step] AS filter,
    list_transform(o[1:step], lambda x: ascii(x) - 64) AS upto, list_transform(o[1:step - 1], lambda x: ascii(x) - 64) AS earlier, ascii(o[step]) - 64 AS own
  FROM steps),
marked AS (
  SELECT part, filter_order, step, filter, n, good, toxic, f[own] AS failing,
    len(list_filter(earlier, lambda x: f[x])) > 0 AS gone,
    len(list_filter(upto, lambda x: f[x])) > 0 AS out, len(list_filter(f, lambda x: x)) = 1 AS once
  FROM cells, places),
counted AS (
  SELECT part, filter_order, step, filter,
    CAST(sum(CASE WHEN NOT out THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failing AND once THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN failing AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM marked GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted
"""
