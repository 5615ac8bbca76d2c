"""The pipeline against brute-force versions of its stages."""

import zlib
from array import array

import corpus_pipeline as P
from conftest import SF001
from test_decontamination import brute as brute_leaks
from test_secrets import brute_linked
from test_simhash import brute_components, brute_print

from dqengine.llm import bpe
from dqengine.llm.quality import quality_scores
from dqengine.sources.tables import read_table


def hidden(text):
    out, end = [], 0
    for k, a, b in brute_linked(text):
        if a >= end:
            out += [text[end:a], f"[{k}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def test_stages_against_brute_force(spark):
    docs, bench = read_table(spark, SF001, "documents"), read_table(spark, SF001, "benchmark")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_scores(docs, read_table(spark, SF001, "labels")).where("predicted = 1").collect()}
    keys = sorted(good)
    first = brute_components(keys, [brute_print(rows[k]) for k in keys])
    single = [k for k, c in zip(keys, first, strict=True) if k == c]
    leaky = {d for d, *_ in brute_leaks([(k, rows[k]) for k in single], [tuple(r) for r in bench.collect()])}
    want = {k: hidden(rows[k]) for k in single if k not in leaky}

    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, SF001)
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    assert {r.doc_id: r.text for r in kept.collect()} == want and 0 < len(want) < len(rows)

    library = bpe.vocabulary(*bpe.vocabulary_files()).library
    got = P.run(spark, SF001).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(want)
    for k, own in pieces.items():
        ids = library.encode(want[k], add_special_tokens=False).ids + [0]
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(own)):
            assert piece == n and start == at and 0 < length <= 2048 and (n == 0 or length == 2048)
            assert crc == zlib.crc32(array("I", ids[at:at + length]).tobytes())
            at += length
        assert at == len(ids)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(fill) <= 1.02 * total / 2048 + 1


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing column names and empty tables go through."""
    text = "An ordinary sentence that stands here, " * 6
    rows = [(1, text, "x", None), (1, text, "x", None), (None, None, None, 1), (None, "token = abcdefgh12 and words", "x", 2), (3, "", "x", 3), (4, "short", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, spans int")
    for name in ("labels", "benchmark"):
        read_table(spark, SF001, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    for start in (docs, docs.limit(0)):
        assert P.quality(spark, start, str(tmp_path)).columns == docs.columns
        kept = start
        for _, stage in P.STAGES[1:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns
        packed = P.packing(spark, kept, str(tmp_path)).collect()
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert len(packed) == len(got)
        if start is docs:  # the null text and the empty one are alike: the one with a key stays
            assert sorted(got, key=str) == sorted([(1, text), (None, "[assign] and words"), (3, ""), (4, "short")], key=str)
