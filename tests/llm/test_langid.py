"""Language ID against posteriors computed row by row, and tables without languages."""

import math
import random

import numpy as np
from twinloom.llm import langid

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = {"en": "the house and garden of that old man with many trees", "de": "das haus und der garten von diesem alten mann mit vielen", "fr": "la maison et le jardin de ce vieil homme avec beaucoup"}


def posteriors(feats, size):
    """The fusion of the docstring, spelt out with dicts."""
    def soft(x):
        e = np.exp(np.array(x) - max(x))
        return e / e.sum()

    p = [soft(f["text"]) for f in feats]
    total = np.sum(p, axis=0) + 1.0 if p else np.ones(size)
    base = total / total.sum()
    tables = {}
    for f, x in zip(feats, p, strict=True):
        for key in (("host", f["domain"], f["host"]), ("domain", f["domain"]), ("said", f["declared"]), ("placed", f["address"])):
            tables[key] = tables.get(key, 0) + x
    out = []
    for f in feats:
        domain = (tables["domain", f["domain"]] + langid.DOMAIN_WEIGHT * base) / (tables["domain", f["domain"]].sum() + langid.DOMAIN_WEIGHT)
        own = tables["host", f["domain"], f["host"]]
        logs = np.array(f["text"]) + np.log((own + langid.HOST_WEIGHT * domain) / (own.sum() + langid.HOST_WEIGHT))
        for name in ("said", "placed"):
            value = f["declared" if name == "said" else "address"]
            if value:
                logs = logs + np.log((tables[name, value] + langid.TABLE_WEIGHT / size) / (total + langid.TABLE_WEIGHT))
        out.append(soft(logs))
    return out


def corpus(spark, r):
    rows = [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(1, 30))), lang, f"src{i % 3}", 1) for i, lang in ((i, list(WORDS)[i % 3]) for i in range(60))]
    return spark.createDataFrame(rows, DOCUMENTS)


def check(feats, langs):
    rows = [x.asDict() for x in feats.collect()]
    got = {x["id"]: x for x in langid.fuse(feats, langs).collect()}
    assert len(got) == len(rows)
    for row, want in zip(rows, posteriors(rows, len(langs)), strict=True):
        assert np.allclose(got[row["id"]]["posterior"], want, atol=2e-5), row
        assert math.isclose(got[row["id"]]["confidence"], want.max(), abs_tol=2e-5)
        if np.sort(want)[-1] - np.sort(want)[-2] > 1e-4:
            assert got[row["id"]]["lang"] == langs[int(want.argmax())]


def test_posteriors_of_pages(spark, monkeypatch):
    r = random.Random(1)
    docs = corpus(spark, r)
    page = lambda lang, text: f"<html lang='{lang}'><p>{text}</p></html>"
    urls = ["http://a.example.de/de/1", "http://b.example.de/x", "https://hot.example.com/en/2", "https://hot.example.com/fr/3", None]
    rows = [(i, urls[2] if i % 3 else r.choice(urls), r.choice([page(r.choice(["en", "de", "xx"]), " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(0, 12)))), "", None]), "x", "y") for i, lang in ((i, r.choice(list(WORDS))) for i in range(150))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, posterior string, n long".replace("n long", "n string"))
    model = langid.fit_text(docs)
    named = pages.selectExpr("page_id id", "html text", "url host_or_url", "cast(null as string) declared")
    check(langid.features(named, model, True), model[0])
    monkeypatch.setattr(langid, "MOST", 0)  # tables of evidence that are too large to broadcast
    check(langid.features(named, model, True), model[0])
    assert langid.identify_pages(pages, docs).count() == 150


def test_posteriors_of_documents(spark):
    docs = corpus(spark, random.Random(2))
    model = langid.fit_text(docs)
    check(langid.features(docs.selectExpr("doc_id id", "text", "source host_or_url", "lang declared"), model, False), model[0])


def test_tables_without_languages(spark):
    docs = corpus(spark, random.Random(3))
    pages = spark.createDataFrame([(1, "http://a.de", "<p>text here</p>"), (2, None, None)], "page_id long, url string, html string")
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars").unionByName(spark.createDataFrame([(900, "12 !", None, None, 0)], DOCUMENTS))
    assert langid.keep_identified(docs.limit(0)).collect() == [] and langid.identify_documents(docs.limit(0)).collect() == []
    assert {x["doc_id"] for x in langid.keep_identified(bare).collect()} == set(range(60))
    for few in (docs.limit(0), bare):
        out = {x["page_id"]: x for x in langid.identify_pages(pages, few).collect()}
        assert all(x["lang"] is None and x["confidence"] is None and x["posterior"] == [] for x in out.values())
        assert not out[1]["rejected"] and out[2]["rejected"]


def test_copies_of_one_text_and_a_very_long_one(spark):
    same = spark.range(9000).selectExpr("id doc_id", "'the house and the garden of that old man' text", "'en' lang", "'hot' source", "1 n_chars", "'x' _body", "'y' host", "0 p")
    long_ = spark.createDataFrame([(10_000, " ".join(WORDS["en"].split() * 20_000), "en", "hot", 1, "x", "y", 0)], same.schema)
    kept = langid.keep_identified(same.unionByName(long_))
    assert kept.count() == 9001 and kept.columns == same.columns
