"""Operator 1: benchmark decontamination by MinHash containment search.

A test item leaks into a document when the document holds at least
``threshold`` of the item's word shingles (containment, not resemblance: the
document may be a thousand times longer).  Items are partitioned by the size
of their shingle set; a partition's upper size ``u`` fixes how many minimum
hashes its items are sketched by, ``u - ceil(threshold * u) + 1``.  A document
that holds enough of an item misses at most ``size - ceil(threshold * size)``
of its shingles and so must hold at least one of the sketched ones: the search
has no false negatives however long the document.  Candidates are then
verified by exact containment over shingle texts.

Documents are scanned once, in numpy, against two bitmaps of fixed size (one
of sketched, one of all item shingles), so what tasks get does not grow with
the benchmark or the corpus.  Only shingles that documents share with items
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import arrow_rows, schema_of, staged, text_rows
from .words import gram_blocks

#: Bits of each bitmap (4 MB each).
BITMAP = 1 << 25


def item_shingles(items: DataFrame, key: str, text: str, words: int, threshold: float) -> DataFrame:
    """(item, gram, hash, n, size, sketched): the distinct shingles of every
    item; an item of fewer words is one shingle."""
    kind = items.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"item {kind}, gram string, hash long, n int, size int, sketched boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            out: list[tuple] = []
            for key_, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
                found: dict[str, tuple[int, int]] = {}
                for n in range(words, 0, -1):
                    for _, _, h, at in gram_blocks([t], [n]):
                        found |= {at.gram(i, n): (int(x), n) for i, x in enumerate(h.view(np.int64).tolist())}
                    if found:
                        break
                size = len(found)
                upper = (1 << size.bit_length()) - 1  # the partition: sizes of one binary length
                sketch = upper - int(np.ceil(threshold * upper - 1e-9)) + 1
                least = sorted(found, key=lambda g: (found[g][0] % 2**64, g))[:sketch]
                out += [(key_, g, h, n, size, g in least) for g, (h, n) in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)

    rows = text_rows(items, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of hashes; at most ``BITMAP / 64`` rows come to the driver."""
    bit = F.expr(f"hash & {BITMAP - 1}")
    rows = hashes.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, int(hash & 63))").alias("bits"))
    words = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    map_ = np.zeros(BITMAP // 64, np.int64)
    map_[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return map_.view(np.uint64)


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITMAP - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                    item_text: str = "text", words: int = 5, threshold: float = 0.8, least: int = 1) -> DataFrame:
    """(key, item key, shared, size, containment) for every row of ``docs``
    and every row of ``items`` whose shingles it holds to at least ``threshold``.

    Words are runs of letters, digits and underscores, in lower case.  An item
    of fewer than ``words`` words is a single shingle of all its words; items
    of fewer than ``least`` words (at most ``words``) are left out.  Null and
    empty texts hold nothing and are held by nothing; null keys stay null and
    repeated rows count one by one, on both sides; an empty table on either
    side gives an empty result; other columns are never read.
    """
    spark = docs.sparkSession
    rows = items.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_key}`").alias("id")).alias("item"), F.col(f"`{item_text}`").alias("text"))
    shingles = staged(item_shingles(rows, "item", "text", words, threshold).where(F.col("n") >= least))
    lengths = sorted(r.n for r in shingles.select("n").distinct().collect())
    every, sketched = spark.sparkContext.broadcast(_bitmap(shingles)), spark.sparkContext.broadcast(_bitmap(shingles.where("sketched")))
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"row long, k {kind}, gram string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b)):
            texts = batch.column("text").to_pylist()
            candidate = np.zeros(len(texts), bool)
            found: list[set[str]] = [set() for _ in texts]
            for n, of, h, at in gram_blocks(texts, lengths):
                shared = np.flatnonzero(_held(every.value, h))
                candidate[of[shared[_held(sketched.value, h[shared])]]] = True
                for i in shared.tolist():
                    found[of[i]].add(at.gram(i, n))
            pairs = [(i, g) for i in np.flatnonzero(candidate).tolist() for g in found[i]]
            at = pa.array([i for i, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("k").take(at), pa.array([g for _, g in pairs], pa.string())], schema=arrow)

    texts = text_rows(docs, F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    held = staged(texts.where("text is not null").mapInArrow(scan, schema)) if lengths else spark.createDataFrame([], schema)
    shared = held.join(shingles.select("gram", "item", "size", "sketched"), "gram")
    counts = shared.groupBy("row", "item").agg(F.first("k").alias("k"), F.first("size").alias("size"), F.count(F.lit(1)).alias("shared"), F.bool_or("sketched").alias("candidate"))
    sure = counts.where(F.col("candidate") & (F.col("shared") >= F.col("size") * F.lit(threshold) - 1e-9))
    return sure.select(F.col("k").alias(key), F.col("item.id").alias(item_key), "shared", "size", (F.col("shared") / F.col("size")).alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were.

    Texts are told apart by their 128-bit digest, so null or repeated keys do
    not matter.  Items of fewer than ``words`` words remove nothing: so little
    text cannot be told from ordinary prose.
    """
    digest = F.md5(F.col(f"`{text}`").cast("string"))
    own = docs.select(digest.alias("doc"), F.col(f"`{text}`").alias("text"))
    leaks = contained_items(own, items, "doc", "text", item_key, item_text, words, threshold, least=words).select("doc").distinct()
    rows = docs.select(F.struct("*").alias("row"), digest.alias("doc"))
    return rows.join(leaks, "doc", "left_anti").select("row.*")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    from ..sources.tables import read_table
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
