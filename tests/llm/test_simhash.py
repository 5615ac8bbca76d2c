"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from dqengine.llm import simhash as S


def brute_print(text, shingle=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return [least.get(find(i)) for i in range(len(prints))]


def corpus(n=220):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgÉé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        if i % 3 and out:
            base = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(0, 2)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 20, 120]))))
    return out + ["", None, " \t\n", "A", "a", "one Two three", "ONE two three", "x " * 500, "nb sp\u0085 y z w v"]


def test_fingerprint_is_the_definition(monkeypatch):
    texts = corpus(60)
    assert [S.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    monkeypatch.setattr(S, "TEXT_BLOCK", 37)  # blocks change nothing
    assert [S.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def pairs_of(a, b):
    return {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_bit_sliced_comparisons(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = base[rng.integers(0, 6, 300)]
    for _ in range(5):
        prints ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert pairs_of(*S.block_links(prints, prints, radius, True)) == want
    i, j = S.block_links(prints[:90], prints[90:], radius, False)
    assert pairs_of(i, j + 90) == {(i, j) for i, j in want if i < 90 <= j}
    group = np.sort(rng.integers(0, 40, 300))
    assert pairs_of(*S.shifted_links(prints, group, radius)) == {(i, j) for i, j in want if group[i] == group[j]}


def test_components_against_brute_force(spark):
    texts = corpus()
    keys = [None if i % 50 == 7 else i * 3 % 1000 for i in range(len(texts))]
    docs = spark.createDataFrame([Row(doc_id=k, text=t, fingerprint="clash", least=i) for i, (k, t) in enumerate(zip(keys, texts, strict=True))], "doc_id long, text string, fingerprint string, least int")
    got = S.simhash_components(docs.union(docs.limit(3))).collect()
    prints = [brute_print(t) for t in texts] + [brute_print(t) for t in texts[:3]]
    want = brute_components(keys + keys[:3], prints)
    unsigned = [(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got]
    order = lambda rows: sorted(rows, key=str)
    assert order(unsigned) == order(zip(keys + keys[:3], prints, want, strict=True))
    kept = S.one_of_each(docs.union(docs.limit(3)))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(k for k in ids if k is not None) == sorted({c for c in want if c is not None})
    assert ids.count(None) == len({p for p, c in zip(prints, want, strict=True) if c is None})


def test_many_near_copies_across_chunks(spark):
    """A bucket far larger than a chunk is compared in full."""
    rng = np.random.default_rng(3)
    prints = np.unique(np.uint64(0xABCDEF0123456789) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    links = S.near_links(df, 4, chunk=64)
    roots = S.connected_components(links).collect()
    assert len(roots) == len(prints) - 1 and len({r.root for r in roots}) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert S.simhash_components(empty).collect() == []
    assert S.one_of_each(empty).collect() == []


def test_one_of_each_with_shared_keys(spark):
    """A key may stand in several components; each keeps a row of its own."""
    a, b, c = ("first text of its own kind, about ships " * 4, "quite another matter: prices, tables, rows " * 4, "drei ganz andere Worte stehen hier im Satz " * 4)
    for rows in ([(5, a, 1), (5, b, 2)], [(5, a, 1), (3, b, 2), (5, b, 3)], [(5, b, 3), (5, a, 1), (3, b, 2)],
                 [(5, a, 1), (5, a, 2), (None, b, 3), (None, c, 4), (None, c, 5), (5, c, 6), (None, None, 7), (None, "", 8)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
        least = {}
        for k, t, _ in rows:
            least[t or ""] = min(least.get(t or "", (True, 0)), (k is None, k or 0))
        got = S.one_of_each(docs).collect()
        assert sorted((r.text or "", (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted(least.items())
        assert {tuple(r) for r in got} <= set(rows)
