"""Hashes of normalised words and word n-grams, block by block in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

from .bpe import BLOCK, LONG_CHUNK, run_hashes

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = True
_STRANGE = re.compile(r"[^\w\x00-\x7f]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> bytes:
    """Lower case, composed letters; whatever is no word character beyond
    ASCII becomes a space (ASCII is told apart byte by byte later)."""
    t = (text or "").lower()
    if not t.isascii():
        t = _STRANGE.sub(" ", unicodedata.normalize("NFC", t))
    return t.encode()


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, hash) of every word of one block."""
    mark = np.diff(WORD[data].astype(np.int8), prepend=0, append=0)
    start = np.flatnonzero(mark == 1)
    size = np.flatnonzero(mark == -1) - start
    if len(data) <= BLOCK + LONG_CHUNK:
        h = run_hashes(data, start, size)
    else:  # a single word of that length
        h = np.zeros(len(start), np.uint64)
    for i in np.flatnonzero(size > LONG_CHUNK).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + size[i]].tobytes())
    return start, size, h


def gram_blocks(texts: Sequence[str | None], lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, "Words"]]:
    """For every n in ``lengths`` and block by block: n, the text of each
    n-gram of normalised words, its hash, and the block's words.  Every n-gram
    of a text appears once for each place it stands at."""
    raws = [normalised(t) for t in texts]
    data = np.frombuffer(b"\n".join(raws), np.uint8)
    first = np.cumsum([0] + [len(r) + 1 for r in raws])[:-1]
    keep = max(lengths, default=1) - 1
    tail = Words(data, *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    at = 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        if to < len(data):  # cut where no word is cut
            gap = np.flatnonzero(~WORD[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:
                while to < len(data) and WORD[data[to]]:
                    more = np.flatnonzero(~WORD[data[to:to + BLOCK]])
                    to += int(more[0]) if len(more) else min(BLOCK, len(data) - to)
        start, size, h = _block_words(data[at:to])
        start += at
        text = np.searchsorted(first, start, "right") - 1
        words = Words(data, *(np.concatenate(x) for x in zip((tail.start, tail.size, tail.text), (start, size, text), strict=True)), np.concatenate([tail.hash, h]))
        for n in lengths:
            # n-grams that lie wholly in the kept tail were given before
            from_ = max(0, len(tail.start) - n + 1)
            count = len(words.start) - n + 1
            if count <= from_:
                continue
            g = np.zeros(count - from_, np.uint64)
            for k in range(n):
                g = (g + words.hash[from_ + k:count + k]) * _MULTIPLIER
                g ^= g >> np.uint64(31)
            ok = np.flatnonzero(words.text[from_:count] == words.text[from_ + n - 1:count + n - 1])
            yield n, words.text[from_ + ok], g[ok], words.at(from_ + ok)
        tail = words.last(keep)
        at = to


class Words:
    """Words of a block: where they stand, their text's number, their hash."""

    def __init__(self, data, start, size, text, hash):
        self.data, self.start, self.size, self.text, self.hash = data, start, size, text, hash
        self.places = np.arange(len(start))

    def at(self, places: np.ndarray) -> "Words":
        w = Words(self.data, self.start, self.size, self.text, self.hash)
        w.places = places
        return w

    def last(self, n: int) -> "Words":
        cut = max(0, len(self.start) - n)
        return Words(self.data, self.start[cut:], self.size[cut:], self.text[cut:], self.hash[cut:])

    def gram(self, i: int, n: int) -> str:
        """The i-th n-gram, its words joined by spaces."""
        p = int(self.places[i])
        return b" ".join(self.data[a:a + s].tobytes() for a, s in zip(self.start[p:p + n].tolist(), self.size[p:p + n].tolist(), strict=True)).decode()
