"""Operator 13: runs (maximal repetitions) in the words of a text.

A run is a stretch of words with smallest period q, at least ``periods`` times
q and ``least`` words long, that neither neighbour extends.

The suffix automaton of the words has a tree of suffix links in which the
ancestors of a prefix's state are all its suffixes.  Appending word i makes i
the last occurrence of every state on that path.  A link-cut tree keeps paths of
states with a common last occurrence as splay trees, and recolouring the path of
word i meets the segments it consists of, O(log n) amortised: for a segment with
last end p whose deepest state is L words long, the L words that end at i also
end at p and no later, so d = i - p is the smallest period of the last L + d
words.  Where L >= d that is a square; every run shows up so when its second
period is complete.  It is then extended both ways to its full length, and
further squares inside it are skipped.

Most words need no automaton.  In a run of n words all but the first q have an
equal word at most q to their left, and these n - q >= (periods - 1) q words
stand together.  So a word whose last equal word lies further to the left than
a (periods - 1)th of the stretch around it cannot be one of them; taken out, it
splits the stretch, and so on.  What is left, with the possible first periods
before it, is given to the automaton.  This guard is exact, runs over whole
batches of texts in numpy, and stops when a round removes little.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_slices
from .common import BLANKS, schema_of, text_rows


class SuffixAutomaton:
    """The automaton of a sequence of small integers, in flat arrays: most
    states have one transition; those with more keep the others in ``more``."""

    def __init__(self, words: list[int]):
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.prefix = array("i")
        last = 0
        for c in words:
            last = self._append(last, c)
            self.prefix.append(last)

    def _new(self, length: int, link: int, word: int, to: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(word)
        self.to.append(to)
        return len(self.length) - 1

    def _go(self, state: int, c: int) -> int:
        if self.word[state] == c:
            return self.to[state]
        others = self.more.get(state)
        return others.get(c, -1) if others else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (c, -1):
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _append(self, last: int, c: int) -> int:
        link, length = self.link, self.length
        new = self._new(length[last] + 1, 0, -1, -1)
        p, q = last, -1
        while p != -1:
            q = self._go(p, c)
            if q != -1:
                break
            self._set(p, c, new)
            p = link[p]
        if p == -1:
            return new
        if length[q] != length[p] + 1:
            copy = self._new(length[p] + 1, link[q], self.word[q], self.to[q])
            if q in self.more:
                self.more[copy] = dict(self.more[q])
            link[q], old, q = copy, q, copy
            while p != -1 and self._go(p, c) == old:
                self._set(p, c, copy)
                p = link[p]
        link[new] = q
        return new


class LastOccurrences:
    """A link-cut tree over a tree given by parents.  Each preferred path is a
    splay tree by depth; the last time a path was reached is kept at its root."""

    def __init__(self, parent: array):
        self.up = array("i", parent)
        self.left = array("i", [-1]) * len(parent)
        self.right = array("i", [-1]) * len(parent)
        self.time = array("i", [-1]) * len(parent)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            p = up[x]
            if p == -1 or left[p] != x and right[p] != x:
                return
            g = up[p]
            if g != -1:
                if left[g] == p:
                    self._rotate(p if left[p] == x else x)
                elif right[g] == p:
                    self._rotate(p if right[p] == x else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b != -1:
            up[b] = p
        up[p], up[x] = x, g
        if g != -1 and left[g] == p:
            left[g] = x
        elif g != -1 and right[g] == p:
            right[g] = x
        else:
            self.time[x] = self.time[p]

    def reach(self, x: int, now: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``x`` to the root: (deepest state, last time)
        of every segment, the deepest segment first."""
        time, up, right = self.time, self.up, self.right
        below = -1
        while x != -1:
            self._splay(x)
            yield x, time[x]
            if right[x] != -1:
                time[right[x]] = time[x]
            right[x], below, x = below, x, up[x]
        time[below] = now


def equal_words(a: np.ndarray, b: np.ndarray) -> int:
    """For how long two sequences agree from their beginnings on."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at:min(at + size, n)] != b[at:min(at + size, n)])
        if len(differ):
            return at + int(differ[0])
        at, size = at + size, 2 * size
    return n


def runs_of(ids: np.ndarray, least: int, periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one sequence, by the automaton."""
    automaton = SuffixAutomaton(ids.tolist())
    length, paths = automaton.length, LastOccurrences(automaton.link)
    found, known = [], {}
    for i, state in enumerate(automaton.prefix):
        for deepest, end in paths.reach(state, i):
            d, n = i - end, length[deepest]
            if end < 0 or n < (periods - 1) * d or known.get(d, -1) >= i:
                continue
            start = i - d - n + 1
            start -= equal_words(ids[:start][::-1], ids[:start + d][::-1])
            stop = i + 1 + equal_words(ids[i + 1:], ids[i + 1 - d:])
            known[d] = stop - 1
            if stop - start >= max(least, periods * d):
                found.append((start, stop - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def windows(ids: np.ndarray, first: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Stretches of ``ids`` outside which there is no run, none of them across
    the beginnings of texts in ``first`` (for each word the place where its text
    begins)."""
    n = len(ids)
    place = np.arange(n)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    gap = place - before
    alive = before >= first
    left = np.count_nonzero(alive)
    while left:
        edge = np.diff(np.concatenate([[0], alive.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - begin
        most = size // (periods - 1)  # the longest period there
        at = np.flatnonzero(alive)
        alive[at] = gap[at] <= np.repeat(np.where(size + most >= least, most, 0), size)
        left, was = np.count_nonzero(alive), left
        if was - left <= was >> 5:
            break
    edge = np.diff(np.concatenate([[0], alive.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    most = (end - begin) // (periods - 1)
    out: list[tuple[int, int]] = []
    for a, b in zip(np.maximum(begin - most, first[begin] if len(begin) else 0).tolist(), end.tolist(), strict=True):
        while out and a < out[-1][1]:
            a = min(a, out.pop()[0])
        out.append((a, b))
    return out


def runs_of_texts(texts: list[bytes], least: int, periods: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and the runs of each text."""
    number = defaultdict(count().__next__)
    words = [t.split() for t in texts]  # at ASCII blanks, which no other UTF-8 sequence holds
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((number[w] for own in words for w in own), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in windows(ids, np.repeat(begin, sizes), least, periods):
        text = int(np.searchsorted(begin, a, "right")) - 1
        found[text] += [(start + a - int(begin[text]), n, d) for start, n, d in runs_of(ids[a:b], least, periods)]
    yield from zip(words, found, strict=True)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that some run holds after
    its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, n, d in runs:
            keep[start + d:start + n] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, periods: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``runs`` (an array of
    start, length, period, in words from 0, by start, then period) and
    ``collapsed``, the text with one period left of each run.

    Words stand between ASCII blanks.  A null text counts as empty: no words, no
    runs, an empty collapsed text.  A null key stays null; repeated rows give
    repeated results, an empty table an empty one; other columns are never read,
    whatever their names.  Texts of any length are taken whole: memory per task
    is a slice of rows (512 KB of text, or one longer text) with some 100 bytes
    a word, and some 150 bytes a word for what a run may cover.  No shuffle.
    """
    if periods < 2 or least < 1:
        raise ValueError("a run has at least two periods and one word")
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b)):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            each = list(runs_of_texts(texts, least, periods))
            runs = [[{"start": a, "length": n, "period": d} for a, n, d in r] for _, r in each]
            yield pa.RecordBatch.from_arrays([
                batch.column("k"), pa.array([len(w) for w, _ in each], pa.int64()), pa.array(runs, arrow.field("runs").type),
                pa.array([collapsed(w, r) for w, r in each], pa.binary()).cast(pa.string())], schema=arrow)

    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a check sum of their key,
    goes on with its words from word a on over and over, p words at a time."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    words = base.withColumn("w", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), F.array_remove(F.split("text", f"[{BLANKS}]+"), "")))
    n = F.size("w").cast("long")
    cut = words.withColumn("a", F.when(F.size("w") > 0, F.col("g") % n))
    cut = cut.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    times = F.ceil((F.size("w") - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), F.size("w") - a)
    return cut.select("doc_id", F.when(a.isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), a), again), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods in all documents, a tenth of
    which are made to repeat."""
    from ..sources.tables import read_table
    found = periodic_runs(with_repeats(read_table(spark, sf_dir, "documents")), least=6, periods=4)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", "n_words", "runs", best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"),
                       period.alias("period"), F.floor(F.try_divide(1000 * length, period)).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256", "n_words")
