"""Byte-level BPE of whole texts through a bounded table of text chunks.

A byte-level BPE vocabulary first cuts a text into pretokens by a fixed
pattern, then merges bytes inside each pretoken.  A space that stands between
two non-blank characters always begins a new pretoken, so a text may be cut
there into chunks that are encoded independently of each other.  Chunks
follow Zipf's law: a bounded table per Python worker, held in numpy arrays,
answers most of a corpus without building a Python object per word.  A 64-bit
hash only says where a chunk may stand in the table; its bytes are kept there
and compared on every hit, so chunks with equal hashes never share values.

Chunks that the table lacks go to the public libraries: ``tiktoken`` (the same
vocabulary as ranks) for plain Latin text, many chunks in one call, and
``tokenizers`` itself for every other chunk, where the two libraries' Unicode
tables might differ, and for chunks that hold a special string.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: Chunks that a worker process keeps (about 10 MB); further ones are encoded, not kept.
TABLE_CHUNKS = 150_000
#: Longer chunks (text without spaces) are encoded one by one, never kept.
LONG_CHUNK = 4096
#: Bytes of text that are hashed and looked up at once.
BLOCK = 1 << 18


def _byte_set(*codes: int) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


BLANK = _byte_set(*range(9, 14), *range(0x1C, 0x21))
#: First bytes of characters among which are blanks beyond ASCII.
MAYBE_BLANK = _byte_set(0xC2, 0xE1, 0xE2, 0xE3)
#: Bytes of printable ASCII, tab, line ends and Latin letters up to U+027F.
PLAIN = _byte_set(9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC3, 0xCA))
_RANDOM = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that can be hashed at once.
HASHED = 2 * BLOCK
_POWERS = np.cumprod(np.full(HASHED, _BASE, np.uint64), dtype=np.uint64)
_INVERSE = np.cumprod(np.full(HASHED, pow(_BASE, -1, 2**64), np.uint64), dtype=np.uint64)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each non-empty text, and before each space
    between two characters that are surely not blank."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    wide = (before >= 0x80) & ((data[at - 2] == 0xC2) | MAYBE_BLANK[data[at - 3]])
    at = at[~(BLANK[before] | wide | BLANK[after] | MAYBE_BLANK[after])]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    mark = np.zeros(len(data), bool)
    mark[at] = mark[firsts] = True
    return np.flatnonzero(mark)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length - 1`` of every pair, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes (at most ``HASHED`` in all)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * _POWERS[:len(data)], out=sums[1:])
    return mixed((sums[starts + sizes] - sums[starts]) * _INVERSE[starts], sizes)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each run of ``size`` bytes of ``a`` equals that of ``b``."""
    differ = np.flatnonzero(a[spread(a_start, size)] != b[spread(b_start, size)])
    same = np.ones(len(size), bool)
    same[np.searchsorted(np.cumsum(size), differ, "right")] = False
    return same


def mixed(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + sizes.astype(np.uint64)


class HashIndex:
    """Open addressing over numpy arrays: 64-bit hash -> entry number."""

    def __init__(self, most: int):
        self.bits = max(8, int(2 * most - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where there is none."""
        found = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            e = self.entry[slot]
            hit = (self.keys[slot] == h[left]) & (e >= 0)
            found[left[hit]] = e[hit]
            go = ~hit & (e >= 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return found

    def insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        for key, e, s in zip(h, entries.tolist(), (h >> np.uint64(64 - self.bits)).tolist(), strict=True):
            while self.entry[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.keys[s], self.entry[s] = key, e


class ChunkTable:
    """Chunk bytes -> a run of values (token ids, or prefix counts).

    ``fill(blobs)`` gets the bytes of distinct chunks and returns their values
    one after another and the length of each run.
    """

    def __init__(self, fill, dtype, most: int = TABLE_CHUNKS):
        self.fill, self.most, self.n = fill, most, 0
        self.index = HashIndex(most)
        self.values, self.used = np.zeros(1 << 12, dtype), 0
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.text, self.text_used = np.zeros(1 << 12, np.uint8), 0
        self.text_start = np.zeros(1 << 12, np.int64)
        self.text_size = np.zeros(1 << 12, np.int64)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        while n > len(array):
            array = np.concatenate([array, np.zeros_like(array)])
        return array

    def _append(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """New entries; they stay only as far as the index and ``n`` say."""
        need, n = self.used + len(values), self.n + len(lengths)
        self.values = self._room(self.values, need)
        self.start, self.length = self._room(self.start, n), self._room(self.length, n)
        self.values[self.used:need] = values
        self.length[self.n:n] = lengths
        self.start[self.n:n] = self.used + np.cumsum(lengths) - lengths
        return np.arange(self.n, n)

    def _keep(self, h: np.ndarray, entries: np.ndarray, blobs: list[bytes]) -> None:
        text, size = np.frombuffer(b"".join(blobs), np.uint8), np.array([len(b) for b in blobs])
        end, n = self.text_used + len(text), self.n + len(blobs)
        self.text = self._room(self.text, end)
        self.text_start, self.text_size = self._room(self.text_start, n), self._room(self.text_size, n)
        self.text[self.text_used:end] = text
        self.text_size[self.n:n] = size
        self.text_start[self.n:n] = self.text_used + np.cumsum(size) - size
        self.text_used = end
        self.index.insert(h, entries)

    def _find(self, part: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entries of chunks, by hash, length and bytes; -1 where there is none."""
        entry = self.index.find(h)
        hit = np.flatnonzero(entry >= 0)
        e = entry[hit]
        alike = self.text_size[e] == size[hit]
        entry[hit[~alike]] = -1
        hit, e = hit[alike], e[alike]
        entry[hit[~same_bytes(self.text, self.text_start[e], part, at[hit], size[hit])]] = -1
        return entry

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the chunks in order, and how many each chunk has."""
        if not len(starts):
            return self.values[:0], np.zeros(0, np.int64)
        base = int(starts[0])
        part = data[base:int(ends[-1])]
        size = ends - starts
        if len(part) > BLOCK + LONG_CHUNK:  # one chunk without spaces
            return self.fill([part.tobytes()])
        at = starts - base
        h = run_hashes(part, at, size)
        entry = self._find(part, at, size, h)
        lost = np.flatnonzero(entry < 0)
        kept = self.n, self.used
        if len(lost):
            raw, new = part.tobytes(), {}
            back = [new.setdefault(raw[a:a + n], len(new)) for a, n in zip(at[lost].tolist(), size[lost].tolist(), strict=True)]
            blobs = list(new)
            first = np.full(len(blobs), -1)
            first[back[::-1]] = lost[::-1]
            values, lengths = self.fill(blobs)
            entries = self._append(values, lengths)
            entry[lost] = entries[back]
            if self.n + len(blobs) <= self.most and max(map(len, blobs)) <= LONG_CHUNK:
                self._keep(h[first], entries, blobs)
                self.n, self.used = self.n + len(blobs), self.used + len(values)
                kept = self.n, self.used
        n = self.length[entry]
        out = self.values[spread(self.start[entry], n)]
        self.n, self.used = kept
        return out, n

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block by block: each chunk's text, all values, values per chunk."""
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
            values, n = self.runs(data, starts[at:to], ends[at:to])
            yield np.searchsorted(offsets, starts[at:to], "right") - 1, values, n
            at = to

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the texts in order, and how many each text has."""
        out, count = [self.values[:0]], np.zeros(len(offsets) - 1, np.int64)
        for text, values, n in self.blocks(data, offsets):
            out.append(values)
            np.add.at(count, text, n)
        return np.concatenate(out), count


class Vocabulary:
    """A byte-level BPE vocabulary given by its two public files."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import regex
        import tiktoken
        self.json_path, self.ranks_path = json_path, ranks_path
        ranks = self.ranks
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        with open(json_path, encoding="utf-8") as f:
            self.special = {t["content"].encode(): t["id"] for t in json.load(f).get("added_tokens", [])}
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self.ids = ChunkTable(self._ids_of, np.uint32)

    @cached_property
    def library(self):
        """The reference tokenizer, loaded when a chunk needs it."""
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.json_path)

    @property
    def ranks(self) -> dict[bytes, int]:
        with open(self.ranks_path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def simple(self, whole: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of chunks laid end to end: which are plain text that ``tiktoken``
        may encode, and which of these may be joined for one call, as each
        begins with a space before a non-blank and ends with a non-blank."""
        starts = np.concatenate([[0], ends[:-1]])
        strange = np.concatenate([[0], np.cumsum(~PLAIN[whole])])
        plain = strange[ends] == strange[starts]
        raw = whole.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                plain[np.searchsorted(ends, at, "right")] = False
                at = raw.find(s, at + 1)
        second = whole[np.minimum(starts + 1, len(whole) - 1)]
        joined = plain & (ends - starts > 1) & (whole[starts] == 0x20) & ~BLANK[second] & ~BLANK[whole[ends - 1]]
        return plain, joined

    def _ids_of(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole, sizes = np.frombuffer(b"".join(blobs), np.uint8), np.array([len(b) for b in blobs])
        plain, joined = self.simple(whole, np.cumsum(sizes))
        each: list[np.ndarray] = []
        n = np.zeros(len(blobs), np.int64)
        pick, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        if len(pick):
            ids = np.array(self.fast.encode_ordinary(b"".join([blobs[i] for i in pick.tolist()]).decode()), np.uint32)
            last = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes[pick])) + 1
            each.append(ids)
            n[pick] = np.diff(last, prepend=0)
        for i in rest.tolist():
            text = blobs[i].decode()
            ids = self.fast.encode_ordinary(text) if plain[i] else self.library.encode(text, add_special_tokens=False).ids
            each.append(np.array(ids, np.uint32))
            n[i] = len(ids)
        order = np.concatenate([pick, rest])
        start = np.zeros(len(blobs), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(each)[spread(start, n)], n


@lru_cache(maxsize=4)
def vocabulary(json_path: str, ranks_path: str, pattern: str) -> Vocabulary:
    """The vocabulary, loaded once per worker process."""
    return Vocabulary(json_path, ranks_path, pattern)


def vocabulary_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Paths and pattern of an installed public vocabulary."""
    import public_tokenizers as p
    return p.path(f"{name}.json"), p.path(f"{name}.tiktoken"), p.PATTERN


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null counts as empty."""
    a = texts.cast(pa.string()).fill_null("")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, np.int32)[a.offset:a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
