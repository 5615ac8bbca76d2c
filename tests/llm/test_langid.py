"""Language identification: accuracy, evidence, and the formulas restated."""

import numpy as np
import pytest
from conftest import SF01, SF001
from pyspark.sql import functions as F

from dqengine.llm import langid as L
from dqengine.sources.tables import read_table


def test_text_alone_on_held_out_documents(spark):
    docs = read_table(spark, SF01, "documents")
    held = F.crc32(docs.doc_id.cast("string").cast("binary")) % 3 == 1
    blind = L.document_evidence(docs.where(held).drop("lang", "source"))
    got = L.languages(blind, docs.where(~held)).join(docs.select(F.col("doc_id").alias("k"), F.col("lang").alias("want"), "n_chars"), "k").toPandas()
    assert (got.lang == got.want).mean() > 0.95
    assert (got.lang == got.want)[got.n_chars > 200].mean() > 0.97


def test_page_evidence(spark):
    rows = [(1, "https://user@www.example.co.uk:80/fr/x", '<html lang="fr-CA"><script>var x="<p>";</script><p>Bon&eacute;jour</p><!-- no --></html>'),
            (2, "http://EXAMPLE.de", "<html><meta http-equiv='Content-Language' content='de'>Text"), (3, None, None), (4, "not a url", "plain"), (None, "http://a.b/en?x", "<HTML XML:LANG=EN>")]
    got = [tuple(r) for r in L.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).select("k", F.trim("text"), "declared", "path", "host", "suffix", "domain").collect()]
    assert got == [(1, "Bon jour", "fr", "fr", "www.example.co.uk", "uk", "co.uk"), (2, "Text", "de", None, "example.de", "de", "example.de"), (3, "", None, None, None, None, None),
                   (4, "plain", None, None, None, None, None), (None, "", "en", "en", "a.b", "b", "a.b")]


def restated(rows, names):
    """The fusion for (ll, declared, path, suffix, domain, host) rows."""
    own = [np.exp(r[0]) / np.exp(r[0]).sum() for r in rows]
    n = len(names)
    share = np.sum(own, axis=0) + 1e-9
    out = []
    for i, (ll, declared, path, *levels) in enumerate(rows):
        s = np.array(ll, float)
        for c, value in ((1, declared), (2, path)):
            if value is not None:
                seen = np.sum([o for o, r in zip(own, rows, strict=True) if r[c] == value], axis=0)
                belief = np.array([L.HONEST if x == value else (1 - L.HONEST) / (n - 1) for x in names])
                s += np.log((seen + L.DECLARED * belief) / (share + L.DECLARED))
        p = (share + L.HOST / n) / (share.sum() + L.HOST)
        for c, value in zip((3, 4, 5), levels, strict=True):
            if value is not None:
                others = [o for j, (o, r) in enumerate(zip(own, rows, strict=True)) if r[c] == value and j != i]
                p = (np.sum(others, axis=0) * bool(others) + L.HOST * p) / (len(others) + L.HOST)
        s += np.log(p)
        s = np.exp(s - s.max())
        out.append((names[int(s.argmax())], s.max() / s.sum()))
    return out


def test_fusion_is_the_formula(spark):
    rng = np.random.default_rng(0)
    names = ["de", "en", "fr"]
    pick = lambda values: values[rng.integers(len(values))]
    rows = []
    for _ in range(60):
        ll = rng.normal(0, 1, 3)
        host = pick(["a.x.de", "b.x.de", "y.fr", None])
        rows.append((list(ll - ll.max()), pick(["de", "en", "zz", None]), pick(["fr", None]), host and host[-2:], host and host[-4:], host))
    data = [(i, *r, [float(x) for x in np.exp(r[0]) / np.exp(r[0]).sum()], 5) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*d[:1], [float(x) for x in d[1]], *d[2:]) for d in data], "k long, ll array<double>, declared string, path string, suffix string, domain string, host string, own array<double>, grams long")
    got = {r.k: (r.lang, r.confidence) for r in L.fused(df, names).collect()}
    for i, (lang, confidence) in enumerate(restated(rows, names)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(confidence, abs=1e-9)


def test_weak_text_follows_other_evidence(spark):
    docs = read_table(spark, SF01, "documents")
    rows = [(i, "http://h.example.com/fr/1", f'<html lang="fr">{t}</html>') for i, t in enumerate(["", None, "12 34", "la"] * 5)]
    got = L.languages(L.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")), docs).collect()
    assert {r.lang for r in got} == {"fr"} and len(got) == len(rows)


def test_query_and_empty_tables(spark):
    got = L.op4_language_id(spark, SF001).toPandas()
    docs, pages = read_table(spark, SF001, "documents"), read_table(spark, SF001, "pages")
    assert got.doc_id.notna().sum() == docs.count() and got.page_id.notna().sum() == pages.count()
    declared = got[got.page_id.notna()].dropna(subset=["declared"])
    assert (declared.lang == declared.text_lang).mean() > 0.9
    assert L.languages(L.document_evidence(docs.limit(0)), docs).collect() == []
    assert {r.lang for r in L.languages(L.document_evidence(docs), docs.limit(0)).collect()} == {None}
