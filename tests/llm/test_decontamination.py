"""Containment search against brute force."""

import random
import re

import pytest
from pyspark.sql import Row

from dqengine.llm import decontamination as D
from dqengine.llm import words as W


def shingles(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(n, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set(), k


def brute(docs, items, threshold=0.8):
    out = []
    for d, t in docs:
        for i, x in items:
            own, k = shingles(x)
            w = re.findall(r"\w+", (t or "").lower())
            there = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            if own and len(own & there) >= threshold * len(own) - 1e-9:
                out.append((d, i, len(own & there), len(own)))
    return sorted(out, key=str)


def tables():
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(150)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(5, 70)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "One, two!"), (103, "aa bb cc dd ee"), (None, "null key item with words"), (1, items[1][1])]
    docs = []
    for d in range(160):
        text = prose(rnd.choice([0, 30, 2000]))
        if d % 2 == 0:
            passage = rnd.choice(items[:40])[1].split()
            for _ in range(rnd.randint(0, 4)):
                passage[rnd.randrange(len(passage))] = rnd.choice(vocabulary)
            at = rnd.randint(0, len(text))
            text = text[:at] + [w.upper() + rnd.choice(["", ",", " -"]) for w in passage] + text[at:]
        docs.append((None if d == 8 else d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "here one two there"), (503, "null key — item with words"), (4, docs[4][1])]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = tables()
    d = spark.createDataFrame([Row(doc_id=k, text=t, gram="clash", item="x") for k, t in docs], "doc_id long, text string, gram string, item string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = [(r.doc_id, r.item_id, r.shared, r.size) for r in D.contained_items(d, i).collect()]
    assert sorted(got, key=str) == brute(docs, items) and len(got) > 30
    clean = D.without_leaks(d, i)
    assert clean.columns == d.columns
    leaky = {re.sub(r"\W+", " ", t.lower()) for k, t in docs if t and brute([(k, t)], [x for x in items if x[1] and len(x[1].split()) >= 5])}
    kept = sorted((k for k, t in docs if re.sub(r"\W+", " ", (t or "").lower()) not in leaky), key=str)
    assert sorted((r.doc_id for r in clean.collect()), key=str) == kept


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_grams_across_blocks(monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    texts = ["a b c d e f g " * 30, "", None, "x" * 500 + " y z", "É è, ê—ë f", "tail of it"]
    for n in (1, 3, 5):
        got = [[] for _ in texts]
        for _, of, _, at in W.gram_blocks(texts, [n]):
            for i, t in enumerate(of.tolist()):
                got[t].append(at.gram(i, n))
        for t, g in zip(texts, got, strict=True):
            w = re.findall(r"\w+", (t or "").lower())
            assert g == [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contained_items(docs, none).collect() == []
    assert D.without_leaks(docs, none).count() == 1
    assert D.contained_items(docs.limit(0), none.union(docs)).collect() == []


def test_item_length_is_counted_in_the_words_of_the_search(spark):
    """Items of five words remove whatever their script, items of four nothing."""
    long = ["это короткий вопрос для проверки модели", "ποια είναι η πρωτεύουσα της χώρας", "ما هي عاصمة هذا البلد", "東京 は 日本 の 首都 です"]
    short = ["Hello, what is this?", "(one) two, three: four!", "東京は日本の首都です。"]
    items = spark.createDataFrame(list(enumerate(long + short)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before, {t} after") for i, t in enumerate(long + short)], "doc_id long, text string")
    assert sorted(r.doc_id for r in D.without_leaks(docs, items).collect()) == [4, 5, 6]
    assert {(r.doc_id, r.item_id) for r in D.contained_items(docs, items).collect()} >= {(i, i) for i in range(6)}
