"""Runs against all pairs of places and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dqengine.llm import periodic as P
from dqengine.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least, periods):
    """Every maximal stretch of every period, the smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(least, periods * q):
                found.setdefault((start, length), q)
            i = j + 1
    # a stretch of period q is one of 2q, 3q, ...: the smallest was seen first
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        n, k = rnd.randint(0, 60), rnd.randint(1, 4)
        words = [rnd.randrange(k) for _ in range(n)]
        if rnd.random() < 0.6 and n:
            at, p = rnd.randrange(n), rnd.randint(1, 9)
            unit = [rnd.randrange(k) for _ in range(p)]
            words[at:at] = unit * rnd.randint(2, 7) + unit[:rnd.randrange(p + 1)]
        yield words


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (1, 2), (5, 3), (30, 2)])
def test_runs_by_the_automaton(least, periods):
    for words in sequences(least * 10 + periods, 400):
        assert P.runs_of(np.array(words, np.int64), least, periods) == brute(words, least, periods)


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_many_texts_with_the_guard(least, periods):
    every = list(sequences(1000 + least, 300)) + [[i for i in range(50)] * 5, list(range(200)) * 3, [0, 1] * 100, [0] * 6, [0] * 5]
    texts = [" ".join(f"w{i}" for i in words).encode() for words in every]
    for words, (split, runs) in zip(every, P.runs_of_texts(texts, least, periods), strict=True):
        assert len(split) == len(words)
        assert runs == brute(words, least, periods)


def test_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    for words in (b, [0] * 500, ([1, 2, 3] * 5 + [4]) * 12, [i % 7 for i in range(600)]):
        assert P.runs_of(np.array(words), 2, 2) == brute(words, 2, 2)


def test_link_cut_paths():
    """Segments of a path against last times kept for every node."""
    rnd = random.Random(2)
    for _ in range(50):
        n = rnd.randint(1, 40)
        parent = P.array("i", [-1] + [rnd.randrange(i) for i in range(1, n)])
        tree, last = P.LastOccurrences(parent), [-1] * n
        for now in range(60):
            x = rnd.randrange(n)
            path = [x]
            while parent[path[-1]] != -1:
                path.append(parent[path[-1]])
            got = list(tree.reach(x, now))
            at = [path.index(v) for v, _ in got]
            assert at[0] == 0 and at == sorted(at)
            for (_, time), a, b in zip(got, at, at[1:] + [len(path)], strict=True):
                assert {last[v] for v in path[a:b]} == {time}
            for v in path:
                last[v] = now


def test_long_repetition():
    words = [f"w{i}" for i in range(997)]
    text = ("head " + " ".join(words * 60) + " tail").encode()
    [(split, runs)] = list(P.runs_of_texts([text], 6, 4))
    assert runs == [(1, 997 * 60, 997)]
    assert P.collapsed(split, runs) == ("head " + " ".join(words) + " tail").encode()


def rewritten(key, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(key, text):
    words = rewritten(key, text)
    runs = brute(words, 6, 4)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(keep).encode()).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x  y\tx\x0by x\ny x y x y", "日本 é 日本 é 日本 é 日本 é 日本 é", "a b c " * 30, "　wide blanks　 are words　" * 8]
    rows = [(i, rnd.choice(texts), i) for i in range(60)] + [(None, "b " * 9, 1)] * 2
    rows += [(100 + i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 150))), 0) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, runs long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted((expected(k, t) for k, t, _ in rows), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows) > 20


def test_empty_table_and_parameters(spark):
    docs = spark.createDataFrame([(1, "a a a a", "k")], "doc_id long, text string, k string")
    assert P.periodic_runs(docs.limit(0)).collect() == []
    row = P.periodic_runs(docs, least=4, periods=2).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (4, [(0, 4, 1)], "a")
    with pytest.raises(ValueError):
        P.periodic_runs(docs, periods=1)
