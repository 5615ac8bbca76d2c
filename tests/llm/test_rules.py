"""Quality rules against a plain restatement."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF01, SF001
from pyspark.sql import Row

from dqengine.llm import rules as R
from dqengine.sources.tables import read_table

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_base(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def js(a, b):
    if not sum(a) or not sum(b):
        return None
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    half = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
    return math.sqrt(max(0, sum(half(x, y) + half(y, x) for x, y in zip(p, q, strict=True)) / 2))


def histograms(text, lang):
    import regex
    text = text or ""
    kinds = [r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[ \t\n\x0b\f\r]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]"]
    c = [len(regex.findall(k, text)) for k in kinds]
    w = [x.lower() for x in WORDS.findall(text)]
    common = [w.count(x) for x in R.COMMON[lang]] if lang in R.COMMON else []
    return c + [len(text) - sum(c)], common + [len(w) - sum(common)] if common else []


def brute(rows):
    rows = [(k, t, lang if lang in R.COMMON else "other") for k, t, lang in rows]
    info = []
    for k, t, lang in rows:
        b = brute_base(t)
        info.append((k, lang, b, b[0] < 10 or 100 * b[4] > 20 * b[0], len(t or ""), *histograms(t, lang)))

    def refs(use):
        out = defaultdict(lambda: [None, None])
        for i in use:
            for n, h in ((0, i[5]), (1, i[6])):
                if h:
                    out[i[1]][n] = [x + y for x, y in zip(out[i[1]][n] or [0] * len(h), h, strict=True)]
        return out

    def distances(i, ref):
        r = ref[i[1]] if i[1] in ref else [None, None]
        return (js(i[5], r[0]) if i[4] >= R.CLASS_LEAST and r[0] else None, js(i[6], r[1]) if i[2][0] >= R.WORD_LEAST and i[6] and r[1] else None)
    ok = lambda d: (d[0] is None or d[0] <= R.CLASS_LIMIT) and (d[1] is None or d[1] <= R.WORD_LIMIT)
    sound = [i for i in info if not i[3]]
    first = refs(sound)
    ref = refs([i for i in sound if ok(distances(i, first))])
    return [(i[0], *i[2], i[3], not i[3] and ok(d), *d) for i in info for d in [distances(i, ref)]]


def compare(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=k, text=t, lang=lang, n_words="clash", c=1) for k, t, lang in rows], "doc_id long, text string, lang string, n_words string, c int")
    got = R.quality_rules(docs).collect()
    rounded = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(rounded, got), key=str) == sorted(map(rounded, brute(rows)), key=str)


def test_odd_texts_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["the", "of", "de", "la", "und", "é,", "A", "x1", "***", "日本", "THE", " ", "a b"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for _ in range(rnd.choice([0, 3, 12, 60, 300]))) for _ in range(120)]
    texts += [None, "", " ", "\n\n", "a b c d e " * 40, "Und " * 50, "one two three four five six seven eight nine ten", "same line\nsame line\n \nother\nsame line"]
    rows = [(None if i == 3 else i, t, rnd.choice(["en", "de", "xx", None])) for i, t in enumerate(texts)]
    compare(spark, rows + rows[:4])


@pytest.mark.parametrize("sf", [SF001])
def test_tables_against_brute_force(spark, sf):
    compare(spark, [(r.doc_id, r.text, r.lang) for r in read_table(spark, sf, "documents").collect()])


def test_clean_documents_stay(spark):
    docs, labels = read_table(spark, SF01, "documents"), read_table(spark, SF01, "labels")
    got = R.quality_rules(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (got[got.quality == 1].kept).mean() > 0.995 and (got[got.quality == 0].kept).mean() < 0.35


def test_plan_is_native(spark):
    plan = R.counted(read_table(spark, SF001, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_empty_table_and_missing_language(spark):
    assert R.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert R.quality_rules(spark.createDataFrame([(1, "no language column " * 9)], "doc_id long, text string")).count() == 1


def test_short_junk_goes_and_short_prose_stays(spark, tmp_path):
    docs, labels = read_table(spark, SF01, "documents").select("doc_id", "text", "lang"), read_table(spark, SF01, "labels")
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rnd.randint(2, 5)))
    lines = lambda n: ".\n".join(" | ".join(word() for _ in range(5)).capitalize() for _ in range(n // 9)) + "."
    junk = [(10**9 + i, lines(rnd.randint(45, 95)), "en") for i in range(30)]
    docs.union(spark.createDataFrame(junk, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    got = R.op9_quality_rules(spark, str(tmp_path)).where("n_words < 100 AND NOT base_failed").toPandas()
    made = got[got.doc_id >= 10**9]
    assert len(made) == 30 and made.kept.mean() < 0.2
    known = got.merge(labels.where("quality = 1").toPandas(), on="doc_id")
    assert len(known) > 20 and known.kept.mean() > 0.98
