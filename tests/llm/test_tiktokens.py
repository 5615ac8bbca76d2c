"""Encoding and decoding against the library on whole texts, merge by merge on
runs it cannot take, and the round trip."""

import hashlib
import random

import numpy as np
import pytest

from dqengine.llm import tiktokens as T
from dqengine.llm.queries import QUERIES

ODD = [None, "", " ", "  ", "\n\n\n", "a  b", "it's 'll they've  \t\n x", "日本 語 texte　x y", "\x1c a b\x85 c", "​ x", "<|endoftext|> x", "🙂 🙂🙂 x", "½ ² ١٢ x", "é" * 50, "\x00a\x00", "ends in blanks   "]


@pytest.fixture(scope="module")
def codec():
    return T.Codec(*T.rank_file())


def merged(codec, piece):
    """One match, merged pair by pair as byte pair encoding says."""
    parts = [bytes([b]) for b in piece]
    ranks = codec.library._mergeable_ranks
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
        if best[0] == 1 << 40:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def plain(codec, text):
    import public_tokenizers
    import regex
    pattern = regex.compile(public_tokenizers.PATTERN)
    return [i for m in pattern.findall(text) for i in merged(codec, m.encode())]


def test_small_texts_are_merged_match_by_match(codec):
    rnd = random.Random(5)
    letters = "ab 'slvre\n\t .é 日🙂12　 \xa0"
    for t in [t or "" for t in ODD] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(300)]:
        assert codec.ids(t).tolist() == plain(codec, t)


@pytest.mark.parametrize("size", [2, 3, 7, 40])
def test_any_cut_gives_the_whole_texts_ids(codec, monkeypatch, size):
    import re
    monkeypatch.setattr(T, "SLICE", size)
    monkeypatch.setattr(T, "_WHITE_RUN", re.compile(f"[{T.WHITE}]{{{size},}}"))
    monkeypatch.setattr(T.slices, "__defaults__", (size,))
    rnd = random.Random(size)
    letters = "ab 's\n\t  \r.é日1　 \xa0\x85"
    for _ in range(400):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80)))
        assert "".join(T.slices(t, size)) == t
        assert codec.ids(t).tolist() == codec.library.encode_ordinary(t), repr(t)


def test_very_long_texts(codec):
    rnd = random.Random(1)
    for t in ["hello  world\n " * 40_000, "".join(rnd.choice("abcdefgh") for _ in range(300_000)), "中国人" * 60_000, "^" * 200_000]:
        assert codec.ids(t).tolist() == codec.library.encode_ordinary(t)
    # white space on which the library's pattern runs out of stack
    run = codec.library._encode_single_piece
    for t, parts in [(" " * 1_500_000, [" " * 1_500_000]), ("x" + "\n" * 900_000 + " y", ["x", "\n" * 900_000, " y"]),
                     ("x" + " \t" * 400_000 + "y", ["x", " \t" * 399_999 + " ", "\t", "y"])]:
        ids = codec.ids(t)
        assert ids.tolist() == [i for p in parts for i in run(p)]
        assert codec.bytes(ids) == t.encode()


def test_rows(spark, codec):
    rows = [(None if i == 3 else i, t, b"clash") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows + rows[4:6], "doc_id long, text string, data binary")
    for packed in (True, False):
        got = T.decode(T.encode(docs, packed=packed)).collect()
        assert sorted((str(r.doc_id), r.n_tokens, bytes(r.data)) for r in got) == sorted(
            (str(k), len(codec.library.encode_ordinary(t or "")), (t or "").encode()) for k, t, _ in rows + rows[4:6])
    whole = T.encode(docs).collect()
    assert {r.doc_id: r.ids for r in whole}[7] == codec.library.encode_ordinary(ODD[7])
    assert T.decode(T.encode(docs.limit(0))).collect() == []


def test_decoding_is_of_raw_bytes(spark, codec):
    ids = codec.library.encode_ordinary("🙂 日")
    df = spark.createDataFrame([(1, ids[:1], "x"), (2, None, "y"), (3, [], "z")], "a int, ids array<int>, data string")
    got = {r.a: r.data for r in T.decode(df).collect()}
    assert got[1] == codec.library.decode_bytes(ids[:1]) and got[2] is None and got[3] == b""
    with pytest.raises(Exception, match="not an id"):
        T.decode(spark.createDataFrame([([99_999_999],)], "ids array<int>")).collect()


def test_query_digests(spark, tmp_path, codec):
    rows = [(i, t, i) for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, ids long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_tiktoken_codec"](spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        ids = np.array(codec.library.encode_ordinary(t or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
