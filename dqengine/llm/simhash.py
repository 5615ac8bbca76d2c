"""Operator 8: SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where most of its shingles' hashes have it.
Fingerprints link when they differ in at most ``radius`` bits.  Candidates
come from the pigeonhole principle: of ``radius + 2`` blocks of bits, two
fingerprints within the radius agree on at least two, so every pair of blocks
is one table of buckets and nothing is missed.

Inside buckets, fingerprints are stored as vertical bit planes (bit p of 64
fingerprints in one machine word).  XOR of two planes gives one bit of 64
distances; carry-save counters of a few words add them up, and a word is
abandoned as soon as all of its distances exceed the radius.  Small buckets
are compared by shifting the planes of a whole batch of buckets against
themselves, larger ones as blocks of queries against planes.

Exact copies share a fingerprint and are one class from the start.  Buckets
are cut into chunks of ``CHUNK`` fingerprints and pairs of chunks are dealt to
tasks, so a bucket of any size is compared in full, in bounded memory; each
task returns a spanning forest of what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, schema_of, staged, text_rows
from .components import connected_components

#: Fingerprints of a bucket that one task compares with each other.
CHUNK = 4096
#: Up to so many, buckets are compared by shifted planes.
SMALL = 64
#: Bytes of a text that are cut into words at once.
TEXT_BLOCK = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def word_blocks(raw: bytes, keep: int) -> Iterator[list[bytes]]:
    """Words between ASCII blanks, block by block; each block begins with the
    last ``keep`` words of the one before."""
    at, tail = 0, []
    while at < len(raw):
        to = at + TEXT_BLOCK
        while to < len(raw) and raw[to] not in b" \t\n\v\f\r":
            to += 1
        words = tail + raw[at:to].split()
        yield words
        tail = words[max(0, len(words) - keep):] if keep else []
        at = to


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned; 0 for a text without words."""
    raw = (text or "").encode().lower()  # bytes: A-Z only
    ones, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    last: list[bytes] = []
    for words in word_blocks(raw, shingle - 1):
        last = words
        if len(words) < shingle:
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)], np.uint64)
        n += len(h)
        lanes = h.view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    if not n:
        return digest(b" ".join(last), seed) if last else 0
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fingerprint as a signed long) for every row; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, fingerprint long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            f = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(f.view(np.int64))], schema=arrow)

    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def planes(prints: np.ndarray) -> np.ndarray:
    """Vertical bit planes: word w of plane p holds bit p of prints 64w..64w+63."""
    words = -(-len(prints) // 64)
    bits = np.zeros((64, words * 64), np.uint8)
    bits[:, :len(prints)] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _within(differ: Callable[[int, np.ndarray], np.ndarray], lanes: np.ndarray, radius: int) -> np.ndarray:
    """Of the lanes (a bit mask in words), those whose distance is within the
    radius.  ``differ(p, at)`` gives plane p of the differences for the words
    at the given places.  Words with no lane left are abandoned every 8 planes."""
    out = np.zeros_like(lanes)
    at = np.flatnonzero(lanes)
    alive = lanes[at]
    counters = [np.zeros_like(alive) for _ in range(radius.bit_length())]
    for p in range(64):
        carry = differ(p, at)
        for c in counters:
            here = c & carry
            c ^= carry
            carry = here
        alive = alive & ~carry  # past the highest counter
        if p % 8 == 7:
            above, equal = np.zeros_like(alive), ~np.zeros_like(alive)
            for bit in range(len(counters) - 1, -1, -1):
                if radius >> bit & 1:
                    equal &= counters[bit]
                else:
                    above |= equal & counters[bit]
                    equal &= ~counters[bit]
            alive = alive & ~above
            left = np.flatnonzero(alive)
            if len(left) < len(alive):
                at, alive, counters = at[left], alive[left], [c[left] for c in counters]
            if not len(at):
                return out
    out[at] = alive
    return out


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, np.uint8)
    bits[:len(flags)] = flags
    return np.packbits(bits, bitorder="little").view(np.uint64)


def shifted_links(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside small groups that lie one after another: the planes of all
    rows against themselves shifted by 1, 2, ... rows."""
    own = planes(prints)
    words = own.shape[1]
    wide = np.concatenate([own, np.zeros((64, 2 + SMALL // 64), np.uint64)], axis=1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1, len(prints)):
        lanes = _packed(group[s:] == group[:-s], words)
        if not lanes.any():
            break
        far, near = s // 64, np.uint64(s % 64)

        def differ(p: int, at: np.ndarray, far=far, near=near) -> np.ndarray:
            other = wide[p, at + far] >> near
            if near:
                other |= wide[p, at + far + 1] << (np.uint64(64) - near)
            return own[p, at] ^ other

        i = _lanes(_within(differ, lanes, radius))
        a.append(i)
        b.append(i + s)
    return np.concatenate(a), np.concatenate(b)


def block_links(queries: np.ndarray, prints: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links from 64 queries at a time to all prints; if both are the same
    rows, only to later ones."""
    own = planes(prints)
    words = own.shape[1]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    every = _packed(np.ones(len(prints), bool), words)
    for first in range(0, len(queries), 64):
        part = queries[first:first + 64]
        ask = np.where((part[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        lanes = np.tile(every, len(part))
        if same:
            lanes = np.concatenate([_packed(np.arange(len(prints)) > first + i, words) for i in range(len(part))])
        got = _within(lambda p, at, ask=ask: own[p, at % words] ^ ask[p, at // words], lanes, radius)
        hit = _lanes(got)
        a.append(first + hit // (words * 64))
        b.append(hit % (words * 64))
    return np.concatenate(a), np.concatenate(b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a task -> (node, smallest node reached), a star per component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def bucket_links(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of buckets (rows sorted by bucket and chunk pair)."""
    _, arrow = schema_of("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
            if kept:
                rows = np.concatenate([*kept, rows], axis=1)
            ends = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            if not len(ends):
                kept = [rows]
                continue
            kept = [rows[:, ends[-1]:]]
            yield solve(rows[:, :ends[-1]], ends)
        if kept and kept[0].shape[1]:
            yield solve(kept[0], np.array([kept[0].shape[1]]))

    def solve(rows: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], ends[:-1]])
        size = ends - starts
        prints, chunk = rows[4].view(np.uint64), rows[3]
        small = np.flatnonzero(size <= SMALL)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(small):
            at = np.repeat(starts[small] - (np.cumsum(size[small]) - size[small]), size[small]) + np.arange(size[small].sum())
            i, j = shifted_links(prints[at], np.repeat(np.arange(len(small)), size[small]), radius)
            a.append(rows[4][at[i]])
            b.append(rows[4][at[j]])
        for g in np.flatnonzero(size > SMALL).tolist():
            own, sides = rows[4][starts[g]:ends[g]], chunk[starts[g]:ends[g]]
            left, right = own[sides == sides.min()], own[sides == sides.max()]
            same = sides.min() == sides.max()
            i, j = block_links(left.view(np.uint64), right.view(np.uint64), radius, same)
            u, v = forest(left[i], right[j])
            a.append(u)
            b.append(v)
        u, v = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=arrow)

    return run


def near_links(prints: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``prints`` (fingerprint), all different -> (u, v): links that connect
    exactly the fingerprints that chains of links within the radius connect."""
    blocks = radius + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [a | b for a, b in combinations(block, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = prints.select("fingerprint", F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m)) for m in signed))).alias("t", "bits"))
    bucket = Window.partitionBy("t", "bits")
    dealt = (keys.withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")
             .withColumn("chunk", F.expr(f"(row_number() over (partition by t, bits order by fingerprint) - 1) div {chunk}"))
             .withColumn("chunks", F.expr(f"(n + {chunk - 1}) div {chunk}")))
    dealt = dealt.select("t", "bits", F.explode(F.expr(
        "transform(sequence(0L, chunks - 1), x -> least(x, chunk) * chunks + greatest(x, chunk))")).alias("pair"), "chunk", "fingerprint")
    dealt = dealt.select(F.col("t").cast("long"), "bits", "pair", F.col("chunk").cast("long"), "fingerprint")
    dealt = dealt.repartition("t", "bits", "pair").sortWithinPartitions("t", "bits", "pair")
    return dealt.mapInArrow(bucket_links(radius), "u long, v long")


def _rooted(own: DataFrame, key: str, radius: int) -> DataFrame:
    """(fingerprint, least, root): of every fingerprint in ``own`` its least key
    and the root of its component."""
    classes = staged(own.groupBy("fingerprint").agg(F.min(key).alias("least")))
    roots = connected_components(near_links(classes.select("fingerprint"), radius))
    found = classes.join(roots.withColumnRenamed("u", "fingerprint"), "fingerprint", "left")
    return staged(found.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))


def _labelled(own: DataFrame, key: str, radius: int) -> DataFrame:
    """(fingerprint, root, component_id) of every fingerprint in ``own``."""
    found = _rooted(own, key, radius)
    return found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fingerprint`` (signed long),
    ``component_id``: the smallest key among all texts that chains of links
    within ``radius`` bits reach.

    A null or empty text has fingerprint 0 and links like any other; null keys
    are passed over for ``component_id`` (null if a component has no other);
    repeated rows give repeated results; an empty table an empty one; other
    columns are never read.
    """
    own = staged(fingerprints(docs, key, text, shingle))
    labels = _labelled(own, key, radius).select("fingerprint", "component_id")
    return own.join(labels, "fingerprint").select(key, "fingerprint", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns as they were.

    Of each component the row with the smallest key stays (where rows of it
    share that, the one with the smallest digest of its text).  Of a component
    without any key one row stays.  Keys are told apart together with the
    digests of their texts, so a key may stand in several components.
    """
    named = F.struct(F.col(f"`{key}`").isNull().alias("bare"), F.col(f"`{key}`").alias("k"), F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("digest"))
    own = staged(fingerprints(docs.select(named.alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", shingle))
    # a minimum is combined before the shuffle, however large the component
    keep = _rooted(own, "id", radius).groupBy("root").agg(F.min("least").alias("id")).select("id")
    rows = docs.select(F.struct("*").alias("row"), named.alias("id"))
    return rows.join(keep, "id", "left_semi").dropDuplicates(["id"]).select("row.*")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from ..sources.tables import read_table
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
