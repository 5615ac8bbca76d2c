"""Operator 10: exact token counts at every prefix, by dynamic programming.

For a byte-level BPE the last token of an encoded prefix determines the rest:
``count[i] = count[i - len(t)] + 1`` where ``t`` is the one vocabulary token
that ends the prefix and is compatible with the last token of the prefix
before it (two tokens are compatible if their joined bytes encode to just
those two).  One pass over a text therefore fills a table with the exact count
of *every* prefix; how many tokens a prefix has, where a budget ends and
whether a text is over a limit are then look-ups, not further encodings.

The recurrence runs inside pretokens; chunks of text (``bpe.ChunkTable``) hold
their part of the table, so a frequent chunk is solved once per worker.  Where
a prefix ends matters for the pretoken pattern in three places, which get the
count of the prefix as it would be encoded alone: after the first blank that
follows a run of blanks, inside a two-letter contraction, and inside a special
string.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import (_INVERSE, _POWERS, _RANDOM, ChunkTable, HashIndex, Vocabulary, mixed, run_hashes, spread,
                  text_buffers, text_slices, vocabulary, vocabulary_files)
from .common import schema_of, text_rows

#: Chunks a worker keeps solved; token pairs whose compatibility it remembers.
CHUNKS = 600_000
REMEMBERED = 500_000
#: Contractions of the pretoken pattern with two letters.
TWO_LETTERS = ("'ll", "'ve", "'re")


def _blank(c: str) -> bool:
    """Whether the pretoken pattern takes the character for a blank."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class PrefixTable:
    """Counts of all prefixes of text chunks under one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.specials = [s.decode() for s in vocab.special]
        if any(" " in s for s in self.specials):
            raise ValueError("special strings with spaces are not supported")
        self.ranks = vocab.ranks
        tokens = list(self.ranks)
        sizes = np.array([len(t) for t in tokens])
        self.longest = int(sizes.max())
        self.token_ids = np.array(list(self.ranks.values()))
        self.token_index = HashIndex(len(tokens))
        self.token_text = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_start = np.cumsum(sizes) - sizes
        self.token_size = sizes
        for at in range(0, len(tokens), 1024):
            n = sizes[at:at + 1024]
            hashes = run_hashes(np.frombuffer(b"".join(tokens[at:at + 1024]), np.uint8), np.cumsum(n) - n, n)
            self.token_index.insert(hashes, np.arange(at, at + len(n)))
        self.token = {i: t for t, i in self.ranks.items()}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pairs, self.pair_fits, self.n_pairs = HashIndex(REMEMBERED), np.zeros(REMEMBERED, bool), 0
        self.table = ChunkTable(self._fill, np.int32, CHUNKS)

    def _fits_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b, joined, encode to just a and b."""
        # every step of this is one to one, so a key is a pair
        key = mixed((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15), np.zeros_like(b))
        entry = self.pairs.find(key)
        fits = self.pair_fits[entry]
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            keys, first, back = np.unique(key[lost], return_index=True, return_inverse=True)
            new = lost[first]
            solved = np.array([self.v.fast._encode_single_piece(self.token[x] + self.token[y]) == [x, y]
                               for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)])
            fits[lost] = solved[back]
            room = min(len(new), REMEMBERED - self.n_pairs)
            places = np.arange(self.n_pairs, self.n_pairs + room)
            self.pairs.insert(keys[:room], places)
            self.pair_fits[places] = solved[:room]
            self.n_pairs += room
        return fits

    def pretoken(self, word: bytes) -> np.ndarray:
        """``count[i]`` for every byte prefix of one pretoken, from 0."""
        return np.concatenate([[0], self._one(word)])

    def pretokens(self, words: list[bytes]) -> list[np.ndarray]:
        """The recurrence for many pretokens at once: place by place, for all
        words that reach it, trying the longest last token first."""
        size = np.array([len(w) for w in words])
        out: list = [None] * len(words)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), 1 << 13):  # of 64 bytes at most
            own = order[at:at + (1 << 13)]
            long = size[own] > 64
            for i in own[long].tolist():
                out[i] = self._one(words[i])
            own = own[~long]
            if len(own):
                n, table = size[own], self._many([words[i] for i in own.tolist()], size[own])
                for i, row, k in zip(own.tolist(), table, n.tolist(), strict=True):
                    out[i] = row[1:k + 1]
        return out

    def _many(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        """``words`` by falling length; a row of counts for each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * _POWERS[:len(data)], out=sums[1:])
        count = np.zeros((len(words), int(size[0]) + 1), np.int32)
        last = np.zeros_like(count)
        for i in range(1, int(size[0]) + 1):
            left = np.arange(int(np.searchsorted(-size, -i, "right")))
            for n in range(min(i, self.longest), 0, -1):
                begin = start[left] + (i - n)
                h = mixed((sums[begin + n] - sums[begin]) * _INVERSE[begin], np.full(len(left), n))
                t = self.token_index.find(h)
                ok = t >= 0
                hit = np.flatnonzero(ok)
                if len(hit):  # the token's own bytes decide
                    own = np.arange(n)
                    same = self.token_text[self.token_start[t[hit], None] + own * (own < self.token_size[t[hit], None])] == data[begin[hit, None] + own]
                    ok[hit] = same.all(1) & (self.token_size[t[hit]] == n)
                t = self.token_ids[t]
                if n < i and ok.any():
                    some = np.flatnonzero(ok)
                    ok[some] = self._fits_all(last[left[some], i - n], t[some])
                rows = left[ok]
                count[rows, i] = count[rows, i - n] + 1
                last[rows, i] = t[ok]
                left = left[~ok]
                if not len(left):
                    break
        return count

    def _one(self, word: bytes) -> np.ndarray:
        """The same for one pretoken, in memory in proportion to its length."""
        ranks, compatible = self.ranks, self.compatible
        count, last = array("i", [0]), array("i", [-1])
        for i in range(1, len(word) + 1):
            for n in range(min(i, self.longest), 0, -1):
                t = ranks.get(word[i - n:i])
                if t is None:
                    continue
                if n < i:
                    pair = (last[i - n], t)
                    fits = compatible.get(pair)
                    if fits is None:
                        fits = self.v.fast._encode_single_piece(self.token[pair[0]] + self.token[t]) == list(pair)
                        if len(compatible) < REMEMBERED:
                            compatible[pair] = fits
                    if not fits:
                        continue
                count.append(count[i - n] + 1)
                last.append(t)
                break
        return np.frombuffer(count, np.int32)[1:]

    @staticmethod
    def _at_code_points(raw: bytes, word: str, count: np.ndarray) -> np.ndarray:
        if len(raw) != len(word):
            follows = np.frombuffer(raw, np.uint8) & 0xC0 == 0x80
            count = count[~np.append(follows[1:], False)]
        if word in TWO_LETTERS:
            count = count.copy()
            count[1] = 2
        return count

    def _pretokens(self, text: str, plain: bool) -> list[str]:
        if plain:
            return self.v.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.v.library.pre_tokenizer.pre_tokenize_str(text)]

    def plain_text(self, text: str, plain: bool) -> list[int]:
        """Counts of all code point prefixes of a text without special strings."""
        out: list[int] = []
        base, run, run_base = 0, "", 0
        for word in self._pretokens(text, plain):
            raw = word.encode()
            count = self.pretoken(raw)
            at = len(out)
            out += (self._at_code_points(raw, word, count[1:]) + base).tolist()
            if run and _blank(word[0]):
                out[at] = run_base + self.pretoken((run + word[0]).encode())[-1]
            blanks = all(map(_blank, word))
            run, run_base = (word, base) if blanks else ("", 0)
            base += int(count[-1])
        return out

    def joined_chunks(self, blobs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain chunks that may be cut into pretokens in one call."""
        words = self.v.pattern.findall(b"".join(blobs).decode())
        solved = {w: i for i, w in enumerate(dict.fromkeys(words))}
        raws = [w.encode() for w in solved]
        counts = [self._at_code_points(r, w, c) for r, w, c in zip(raws, solved, self.pretokens(raws), strict=True)]
        flat, length = np.concatenate(counts), np.array([len(c) for c in counts])
        final = flat[np.cumsum(length) - 1].astype(np.int64)
        raw = np.array([len(r) for r in raws])
        which = np.fromiter(map(solved.__getitem__, words), np.int64, len(words))
        chunk = np.searchsorted(np.cumsum(sizes), np.cumsum(raw[which]) - raw[which], "right")
        first = np.searchsorted(chunk, np.arange(len(blobs)))
        base = np.cumsum(final[which]) - final[which]
        base -= base[first][chunk]
        n = length[which]
        start = (np.cumsum(length) - length)[which]
        values = flat[spread(start, n)] + np.repeat(base, n)
        blank = np.array([all(map(_blank, w)) for w in solved])[which]
        begins = np.array([_blank(w[0]) for w in solved])[which]
        at = np.cumsum(n) - n
        for i in np.flatnonzero(blank[:-1] & begins[1:] & (chunk[:-1] == chunk[1:])).tolist():
            values[at[i + 1]] = base[i] + self.pretoken((words[i] + words[i + 1][0]).encode())[-1]
        return values, np.bincount(chunk, n, minlength=len(blobs)).astype(np.int64)

    def chunk(self, blob: bytes, plain: bool) -> list[int]:
        text = blob.decode()
        if plain:
            return self.plain_text(text, True)
        out: list[int] = []
        base, at = 0, 0
        while True:
            found = [(p, -len(s), s) for s in self.specials if (p := text.find(s, at)) >= 0]
            if not found:
                return out + [base + c for c in self.plain_text(text[at:], False)]
            p, _, s = min(found)
            counts = self.plain_text(text[at:p] + s[:-1], False)
            out += [base + c for c in counts]
            base += (counts[p - at - 1] if p > at else 0) + 1
            out.append(base)
            at = p + len(s)

    def _fill(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(b) for b in blobs])
        plain, joined = self.v.simple(np.frombuffer(b"".join(blobs), np.uint8), ends)
        each, n = [], np.zeros(len(blobs), np.int64)
        pick, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        if len(pick):
            values, n[pick] = self.joined_chunks([blobs[i] for i in pick.tolist()], np.diff(ends, prepend=0)[pick])
            each.append(values)
        for i in rest.tolist():
            counts = np.array(self.chunk(blobs[i], bool(plain[i])), np.int32)
            each.append(counts)
            n[i] = len(counts)
        order = np.concatenate([pick, rest])
        start = np.zeros(len(blobs), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(each)[spread(start, n)], n

    def prefixes(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block by block: the text of each code point and the token count of
        the prefix that ends with it."""
        before = np.zeros(len(offsets) - 1, np.int64)
        for text, values, n in self.table.blocks(data, offsets):
            tokens = values[np.cumsum(n) - 1].astype(np.int64)
            base = np.cumsum(tokens) - tokens
            first = np.flatnonzero(np.diff(text, prepend=-1))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(text))))
            base += (before[text[first]] - base[first])[of]
            yield np.repeat(text, n), values + np.repeat(base, n)
            np.add.at(before, text, tokens)


@lru_cache(maxsize=4)
def prefix_table(*files: str) -> PrefixTable:
    return PrefixTable(vocabulary(*files))


def token_counts(docs: DataFrame, limits: Sequence[int] = (), key: str = "doc_id", text: str = "text",
                 keep_prefixes: bool = False, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes`` (UTF-8), ``n_chars``
    (code points), ``n_tokens``; for every limit L ``chars_at_L``, the code
    points of the longest prefix that has at most L tokens; with
    ``keep_prefixes`` also ``prefix_tokens``, the count of every prefix
    (element k: the first k code points).

    ``files`` are the vocabulary's two files and its pattern.  A null text
    counts as empty: no tokens, an empty array.  A null key stays null,
    repeated rows give repeated results, an empty table an empty one; other
    columns are never read.  Texts of any length are counted whole.  Memory per
    task: the chunk table and one slice of text (512 KB, or one longer text).
    No shuffle.
    """
    files = files or vocabulary_files()
    kind = docs.schema[key].dataType.simpleString()
    spec = f"k {kind}, n_bytes long, n_chars long, n_tokens long" + "".join(f", chars_at_{n} long" for n in limits)
    schema, arrow = schema_of(spec + ", prefix_tokens array<int>" * keep_prefixes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(*files)
        for batch in (s for b in batches for s in text_slices(b)):
            data, offsets = text_buffers(batch.column("text"))
            rows = batch.num_rows
            chars, tokens, kept = np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
            longest = {n: np.zeros(rows, np.int64) for n in limits}
            for of, counts in table.prefixes(data, offsets):
                texts, first, n = np.unique(of, return_index=True, return_counts=True)
                place = np.arange(len(of)) - np.repeat(first, n) + np.repeat(chars[texts], n)
                for limit, best in longest.items():
                    within = np.flatnonzero(counts <= limit)
                    np.maximum.at(best, of[within], place[within] + 1)
                chars[texts] += n
                tokens[texts] = counts[first + n - 1]
                if keep_prefixes:
                    kept.append(counts.astype(np.int32))
            out = [batch.column("k"), np.diff(offsets), chars, tokens, *longest.values()]
            if keep_prefixes:
                ends = np.concatenate([[0], np.cumsum(chars)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, schema).withColumnRenamed("k", key)


def tokens_of_prefix(prefix_tokens: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points, from a stored table."""
    k = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefix_tokens))
    return F.when(k <= 0, F.lit(0)).otherwise(F.element_at(prefix_tokens, k.cast("int")))


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix within ``budget`` tokens, from a
    stored table (counts may fall as a prefix grows, so the last place counts)."""
    at = F.array_position(F.reverse(F.transform(prefix_tokens, lambda c: c <= F.lit(budget))), F.lit(True))
    return F.when(at == 0, F.lit(0)).otherwise(F.size(prefix_tokens) - at + 1).cast("long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents and whether each is over 1024 tokens."""
    from ..sources.tables import read_table
    counts = token_counts(read_table(spark, sf_dir, "documents"), limits=(1024,))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_chars", "chars_at_1024")
