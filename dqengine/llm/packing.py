"""Operator 2: packing token sequences with a linear grouping scheme.

Documents become pieces of at most ``capacity`` tokens; pieces go into
sequences of at most ``capacity`` tokens.  The plan is made on the histogram
of piece lengths (at most ``capacity`` numbers, whatever the corpus), the
pieces themselves are placed by Spark:

1. lengths above ``capacity // small_share`` are large.  In falling order they
   are dealt into ``groups`` groups of equal cardinality, and each is rounded
   up to the longest of its group;
2. with these few sizes, configurations (how many pieces of each size share a
   sequence) are optimised one after another: the longest size that is left,
   completed to the fullest sequence by a bounded subset sum, as often as the
   counts allow;
3. actual lengths replace the rounded ones.  As a group's pieces are taken in
   falling order, sequences with equal contents form runs, of which there are
   O(capacity + configurations);
4. small lengths, in falling order, go to the runs where they fit best, and to
   new sequences where they fit nowhere.

The outcome is an allocation table: pieces of length L with rank a..b among
all pieces of that length go to sequences s, s+1, ... at an offset.  A piece's
rank is its rank within the task that encoded it plus the number of such
pieces in earlier tasks, so no window or sort ever holds all pieces of one
length (a third of the corpus may be copies of one text).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import text_buffers, text_slices, vocabulary, vocabulary_files
from .common import schema_of, staged, text_rows


@dataclass
class Run:
    """Sequences ``first .. first + n - 1``, each filled up to ``used``."""
    first: int
    n: int
    used: int


def rounded_groups(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """(rounded length, pieces) of groups of equal cardinality, longest first."""
    order = np.argsort(-lengths)
    lengths, counts = lengths[order], counts[order]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    each = -(-total // groups) if total else 1
    out: list[tuple[int, int]] = []
    for at in range(0, total, each):
        size, n = int(lengths[np.searchsorted(ends, at, "right")]), min(each, total - at)
        if out and out[-1][0] == size:
            out[-1] = (size, out[-1][1] + n)
        else:
            out.append((size, n))
    return out


def fullest(sizes: list[int], left: list[int], room: int) -> dict[int, int]:
    """How many of each size fill ``room`` best, within what is left."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by, times = np.full(room + 1, -1, np.int32), np.zeros(room + 1, np.int32)
    for j, s in enumerate(sizes):
        base = reach.copy()
        for m in range(1, min(left[j], room // s) + 1):
            new = np.zeros(room + 1, bool)
            new[m * s:] = base[:room + 1 - m * s]
            new &= ~reach
            by[new], times[new] = j, m
            reach |= new
        if reach[room]:
            break
    at, out = int(np.flatnonzero(reach)[-1]), {}
    while at:
        j, m = int(by[at]), int(times[at])
        out[j] = m
        at -= m * sizes[j]
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Contents by size, and how many sequences have them."""
    left, out = list(counts), []
    for j, s in enumerate(sizes):
        while left[j]:
            left[j] -= 1
            fill = fullest(sizes[j:], left[j:], capacity - s)
            left[j] += 1
            need = {j + i: m for i, m in fill.items()}
            need[j] = need.get(j, 0) + 1
            times = min(left[i] // m for i, m in need.items())
            for i, m in need.items():
                left[i] -= m * times
            out.append((need, times))
    return out


def plan(histogram: dict[int, int], capacity: int, groups: int, small_share: int) -> np.ndarray:
    """Allocations (length, first rank, pieces, first sequence, pieces of that
    length in each sequence, offset) for a histogram of lengths."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    taken: Counter[int] = Counter()
    edge = capacity // small_share
    large = sorted((n for n in histogram if n > edge), reverse=True)
    groups_of = rounded_groups(np.array(large, np.int64), np.array([histogram[n] for n in large], np.int64), groups)
    runs: list[Run] = []
    sequences = 0
    # actual lengths of the large pieces in falling order, by place
    ends = np.cumsum([histogram[n] for n in large])
    next_place = np.cumsum([0] + [n for _, n in groups_of])[:-1].tolist()
    for need, times in configurations([s for s, _ in groups_of], [n for _, n in groups_of], capacity):
        slots = []
        for j, m in sorted(need.items()):
            for _ in range(m):
                slots.append(next_place[j])
                next_place[j] += times
        cuts = {0, times}
        for place in slots:
            inner = ends[(ends > place) & (ends < place + times)] - place
            cuts.update(inner.tolist())
        at = sorted(cuts)
        for a, b in zip(at, at[1:], strict=False):
            used = 0
            for place in slots:
                k = int(np.searchsorted(ends, place + a, "right"))
                rank = place + a - int(ends[k - 1] if k else 0)
                rows.append((large[k], rank, b - a, sequences + a, 1, used))
                used += large[k]
            runs.append(Run(sequences + a, b - a, used))
        sequences += times

    by_used: dict[int, list[Run]] = {}
    for r in runs:
        by_used.setdefault(r.used, []).append(r)
    for length in sorted((n for n in histogram if n <= edge), reverse=True):
        left = histogram[length]
        for used in sorted((u for u in by_used if u + length <= capacity), reverse=True):
            per = (capacity - used) // length
            while left and by_used[used]:
                r = by_used[used].pop()
                full = min(r.n, left // per)
                if full:
                    rows.append((length, taken[length], full * per, r.first, per, used))
                    by_used.setdefault(used + per * length, []).append(Run(r.first, full, used + per * length))
                    taken[length] += full * per
                    left -= full * per
                if full < r.n and left:
                    rows.append((length, taken[length], left, r.first + full, left, used))
                    by_used.setdefault(used + left * length, []).append(Run(r.first + full, 1, used + left * length))
                    taken[length] += left
                    full, left = full + 1, 0
                if full < r.n:
                    by_used[used].append(Run(r.first + full, r.n - full, used))
            if not left:
                break
        per = capacity // length
        for n, each in ((left // per, per), (min(1, left % per), left % per)):
            if n:
                rows.append((length, taken[length], n * each, sequences, each, 0))
                by_used.setdefault(each * length, []).append(Run(sequences, n, each * length))
                taken[length] += n * each
                sequences += n
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, capacity: int, key: str, text: str, end_id: int,
                 files: tuple[str, str, str]) -> DataFrame:
    """Pieces of the encoded documents, with the task that made each and its
    rank among the task's pieces of that length."""
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, task, seen = vocabulary(*files), TaskContext.get().partitionId(), Counter()
        for batch in (s for b in batches for s in text_slices(b)):
            ids, count = vocab.ids.texts(*text_buffers(batch.column("text")))
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            at = 0
            for i, n in enumerate(count.tolist()):
                whole = np.concatenate([ids[at:at + n], end])
                at += n
                a, b, k = 0, (n + 1) % capacity or capacity, 0
                while a <= n:
                    size = b - a
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(whole[a:b]))
                    nth.append(seen[size])
                    seen[size] += 1
                    a, b, k = b, b + capacity, k + 1
            cols = [batch.column("k").take(pa.array(row, pa.int64())), piece, start, length, crc, [task] * len(row), nth]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(encode, schema)


def pack(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0,
         groups: int = 1024, small_share: int = 4, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document is its token ids and ``end_id``.  Documents longer than
    ``capacity`` are cut from the end, so only the first piece may be shorter.
    Sequences are gapless from 0 and hold at most ``capacity`` tokens.

    A null text counts as empty (one token, ``end_id``); a null key stays
    null; repeated rows are packed as often as they occur; an empty table
    gives an empty result; other columns are never read.

    Scale: texts are read once and never shuffled; pieces (about 50 bytes
    each) are written once to the shared folder and joined once with the
    per-task counts.  The driver sees the histogram (``capacity`` rows at
    most); the allocation table that tasks get is bounded by the capacity and
    the number of groups, not by the corpus.
    """
    pieces = staged(token_pieces(docs, capacity, key, text, end_id, files or vocabulary_files()))
    counts = staged(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = plan(histogram, capacity, groups, small_share)
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    kind = pieces.schema["k"].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    codes = (table[:, 0] << 44) + table[:, 1]  # lengths and ranks in one sorted number

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            a = table[np.searchsorted(codes, (length << 44) + rank, "right") - 1]
            nth = rank - a[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)),
                                              pa.array(a[:, 3] + nth // a[:, 4]), pa.array(a[:, 5] + nth % a[:, 4] * length)], schema=arrow)

    # a row for each task and length: grows with the corpus, so never broadcast
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).select("k", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, schema).withColumnRenamed("k", key)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    from ..sources.tables import read_table
    return pack(read_table(spark, sf_dir, "documents"), capacity=2048)
