"""Token ids, prefix counts and packing against the tokenizer library."""

import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dqengine.llm import bpe, packing
from dqengine.llm import token_counts as T

ODD = ["", " ", "  ", "a  b", " a", "a ", "\n \n x", "x<|endoftext|>y z", "<|endoftext|>", "<|endo <|endoftext|> <|endoftext|>x", "foo <|endoftext|> bar  <|endoftext|>\n",
       "it's 'll they've 'l we're we'r 'later", "日本 語 texte　x y", "a b c", "a   b c à b Ġ x", "\x1c a b\x85 c", "é é ç", "a \n b", "🙂 🙂🙂 x", "\x00 a\x00b", "½ ² ١٢ x",
       "x" * 300 + " y", "ab " * 30, None, "à   b  c à c", "------ ====== ??!! 1234567 hello  \t\n  World"]


def texts():
    rnd = random.Random(1)
    letters = "ab 'slvre\n\t .é 日<|>endoftext🙂12　"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(200)]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(*bpe.vocabulary_files())


@pytest.mark.parametrize("most", [10, 100_000])
def test_ids_are_the_librarys(vocab, most):
    table = bpe.ChunkTable(vocab._ids_of, np.uint32, most)
    long = ["y" * 9000 + " z", "ab cd " * 60000, "w" * 300_000]
    for _ in range(2):
        ids, n = table.texts(*bpe.text_buffers(pa.array(texts() + long)))
        for t, got in zip(texts() + long, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == vocab.library.encode(t or "", add_special_tokens=False).ids


def test_every_prefix_count(vocab):
    table = T.PrefixTable(vocab)
    out = [[] for _ in texts()]
    for of, counts in table.prefixes(*bpe.text_buffers(pa.array(texts()))):
        for t, c in zip(of.tolist(), counts.tolist(), strict=True):
            out[t].append(c)
    for t, got in zip(texts(), out, strict=True):
        assert got == [len(vocab.library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t or "") + 1)]


def test_counts_and_stored_prefixes(spark, vocab):
    rows = [(None if i == 2 else i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, k string")
    got = T.token_counts(docs, limits=(5,), keep_prefixes=True).withColumns({"four": T.tokens_of_prefix(F.col("prefix_tokens"), 4), "cut": T.longest_prefix(F.col("prefix_tokens"), 5)}).collect()
    assert len(got) == len(rows) + 2
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r, t = by[None if i is None else i], t or ""
        n = lambda x: len(vocab.library.encode(x, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_chars, r.n_tokens, r.four) == (len(t.encode()), len(t), n(t), n(t[:4]))
        assert r.cut == r.chars_at_5 == max([k for k in range(len(t) + 1) if n(t[:k]) <= 5])
    assert T.token_counts(docs.limit(0)).collect() == []


def check(histogram, capacity=64, groups=8, share=8):
    load, ranks = {}, {}
    for length, first, n, seq, per, offset in packing.plan(histogram, capacity, groups, share).tolist():
        ranks.setdefault(length, []).append((first, n))
        for i in range(n):
            load.setdefault(seq + i // per, []).append((offset + i % per * length, length))
    for length, n in histogram.items():
        at = 0
        for first, k in sorted(ranks[length]):
            assert first == at
            at += k
        assert at == n
    for own in load.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(load)


def test_plan_is_whole_and_tight():
    rnd = random.Random(0)
    for _ in range(60):
        check({rnd.randint(1, 64): rnd.randint(1, 40) for _ in range(rnd.randint(0, 30))}, groups=rnd.choice([1, 3, 50]), share=rnd.choice([1, 4, 64]))
    assert check({1: 5000}) == 79 and check({64: 5, 32: 3, 31: 7, 3: 1}) <= 11
    lengths = {n: rnd.randint(20, 60) for n in range(1, 2049)}
    total = sum(k * v for k, v in lengths.items())
    assert check(lengths, 2048, 1024, 4) <= 1.002 * total / 2048 + 1


def test_packed_pieces(spark, vocab):
    rows = [(None if i == 2 else i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[3:6], "doc_id long, text string, task string").repartition(5)
    got = packing.pack(docs, capacity=16, groups=8).collect()
    want = []
    for i, t, _ in rows + rows[3:6]:
        ids = vocab.library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 16 or 16
        cuts = [0, *range(first, len(ids) + 1, 16)]
        want += [(i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    load = {}
    for r in got:
        load.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in load.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16
    assert packing.pack(docs.limit(0)).collect() == []


def thue_morse(n, letters):
    """A string and its complement: equal under any polynomial hash modulo 2^64
    with an odd multiplier, once they are long enough."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join(letters[b ^ flip] for b in bits) for flip in (0, 1)]


COLLIDING = [t for n in (1024, 2048, 4096) for letters in ("ab", "xy", "01", "é日") for t in thue_morse(n // (2 if letters == "é日" else 1), letters)]


@pytest.mark.parametrize("together", [True, False])
def test_chunks_with_equal_hashes(vocab, together):
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in thue_morse(2048, "ab"))
    zero, whole = np.zeros(1, np.int64), np.array([2048])
    assert bpe.run_hashes(a, zero, whole) == bpe.run_hashes(b, zero, whole)
    ids, counts = bpe.ChunkTable(vocab._ids_of, np.uint32), T.PrefixTable(vocab)
    for batch in [COLLIDING] if together else [[t] for t in COLLIDING * 2]:
        buffers = bpe.text_buffers(pa.array(batch))
        got, n = ids.texts(*buffers)
        for t, own in zip(batch, np.split(got, np.cumsum(n)[:-1]), strict=True):
            assert own.tolist() == vocab.library.encode(t, add_special_tokens=False).ids
        last = {}
        for of, c in counts.prefixes(*buffers):
            last |= dict(zip(of.tolist(), c.tolist(), strict=True))
        assert [last[i] for i in range(len(batch))] == [len(vocab.library.encode(t, add_special_tokens=False).ids) for t in batch]


def test_every_prefix_of_colliding_chunks(vocab):
    table = T.PrefixTable(vocab)
    for t in thue_morse(1024, "ab"):
        got = np.concatenate([c for _, c in table.prefixes(*bpe.text_buffers(pa.array([t])))])
        assert got.tolist() == [len(vocab.library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)]


def test_a_hash_without_any_information(vocab, monkeypatch):
    """All chunks of a length and all tokens of a length share one hash."""
    monkeypatch.setattr(bpe, "run_hashes", lambda data, starts, sizes: (sizes % 3).astype(np.uint64) << np.uint64(61))
    table = bpe.ChunkTable(vocab._ids_of, np.uint32, 3000)
    for _ in range(2):
        ids, n = table.texts(*bpe.text_buffers(pa.array(texts()[:60])))
        for t, got in zip(texts()[:60], np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert got.tolist() == vocab.library.encode(t or "", add_special_tokens=False).ids
