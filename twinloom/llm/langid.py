"""Language ID by Bayesian fusion of text, declared language, address suffix and host priors.

Four kinds of evidence meet in one posterior over the model's languages:

* text: hashed byte-trigram likelihoods, fitted on at most ``TRAIN_DOCS``
  different labelled texts (a bounded sample in the order of a hash, in equal
  shares of the languages as far as they have as many); since neighbouring
  trigrams are far from independent, the log-likelihood is scaled down to
  ``EFFECTIVE`` trigrams;
* the language that the markup declares (``<html lang=...>``, anywhere in the page);
* the address: top-level domain and a language code as first path segment;
* the host: priors smoothed up the hierarchy host -> domain -> all pages.

The tables behind the last three are grouped sums of the text posteriors over
all rows: P(declared | language), P(address | language) and the host priors.
Every one is aggregated on the map side, written, and joined back on its key,
of which one may hold any share of the rows: it is broadcast if a count shows
it to be small, else both sides are plain scans, so that adaptive execution
can split a hot key's rows.

Defined cases: a row with null or empty text and no other evidence gets the
prior of all pages; a null address has host, domain and address key ''; a
null id stays null; repeated rows are counted each and get equal results; a
text of any length counts whole; without any labelled text there is no
language to tell: lang and confidence are null, posteriors are empty, and only
texts without letters are rejected; an empty table gives an empty table. Only
the named columns are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import map_batches, ship, sized, unit, written

TRAIN_DOCS = 4000
BITS = 16
EFFECTIVE = 60.0
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 8.0, 8.0, 4.0
SURE = 0.5
#: Probabilities in a table of evidence that is broadcast.
MOST = 800_000
#: When a document's text contradicts its declaration; typical texts have a mean of about -6, foreign ones below -11.
LONG, FITS, MARGIN = 100, -8.0, 2.0

_TAGS = re.compile(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<nav.*?</nav>|<[^>]*>|&[a-zA-Z#0-9]+;")
_HTML = re.compile(r"(?i)<html[^>]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z]+)")
_URL = re.compile(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)[^/?#]*/?([^?#]*)")
_KEEP = np.zeros(256, np.uint8)
_KEEP[list(range(97, 123)) + list(range(128, 256))] = list(range(97, 123)) + list(range(128, 256))
_KEEP[65:91] = np.arange(97, 123)


def trigrams(text: str) -> np.ndarray:
    """Hashes below 2**BITS of the byte trigrams of a text: letters in lower case, anything else one blank."""
    raw = _KEEP[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)].astype(np.uint32)
    solid = raw[(raw != 0) | (np.concatenate(([1], raw[:-1])) != 0)] if len(raw) > 2 else raw
    if len(solid) < 3:
        return np.zeros(0, np.uint32)
    return ((solid[:-2] * np.uint32(0x9E3779B1) + solid[1:-1] * np.uint32(0x85EBCA6B) + solid[2:] * np.uint32(0xC2B2AE35)) ^ (solid[1:-1] << 7)) >> np.uint32(32 - BITS)


def shares(found: dict[str, int], limit: int) -> dict[str, int]:
    """How many texts of each language to take, of limit in all: equal shares, what small ones leave goes to the others; one at least."""
    out: dict[str, int] = {}
    for i, k in enumerate(sorted(found, key=lambda k: (found[k], k))):
        out[k] = max(1, min(found[k], (limit - sum(out.values())) // (len(found) - i)))
    return out


def sample(docs: DataFrame, text_col: str, lang_col: str, limit: int) -> DataFrame:
    """lang and text of different labelled texts, the first of each language in the order of a hash of the text."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null").withColumn("_u", unit(F.col("text")))
    spark = docs.sparkSession
    # about twice each share and 30 pass the filter by hash: the driver gets no more numbers than that, and no language is missed
    about = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("_u").alias("n")).collect()}
    some = spark.createDataFrame([(k, (2.0 * n + 30.0) / max(1, about[k])) for k, n in shares(about, limit).items()], "_lang string, _most double")
    passed: dict[str, list[float]] = {}
    for r in rows.join(F.broadcast(some), (F.col("lang") == F.col("_lang")) & (F.col("_u") < F.col("_most"))).select("lang", "_u").distinct().collect():
        passed.setdefault(r["lang"], []).append(r["_u"])
    take = shares({k: len(v) for k, v in passed.items()}, limit)
    last = spark.createDataFrame([(k, sorted(v)[take[k] - 1]) for k, v in passed.items()], "_lang string, _last double")
    return rows.join(F.broadcast(last), (F.col("lang") == F.col("_lang")) & (F.col("_u") <= F.col("_last"))).select("lang", "text").distinct()


def fit_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limit: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-likelihoods [language, trigram]) from at most limit labelled texts of docs."""
    ship(docs.sparkSession)
    rows = sample(docs, text_col, lang_col, limit)

    def count(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BITS, np.int64)
        for text in part["text"]:
            total += np.bincount(trigrams(text), minlength=1 << BITS)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [total.tolist()]})

    found = rows.groupBy("lang").applyInPandas(count, "lang string, counts array<long>").collect()
    found = sorted(((r["lang"], np.array(r["counts"], np.float64)) for r in found), key=lambda x: x[0])
    if not found:
        return [], np.zeros((0, 1 << BITS))
    logs = np.log(np.stack([c for _, c in found]) + 0.05)
    logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))
    return [k for k, _ in found], logs


def declared(html: str) -> str | None:
    """The language of the first html tag of a page that names one, wherever it stands; one pass over the page."""
    return next((m[1] for tag in _HTML.finditer(html) if (m := _LANG.search(tag[0]))), None)


def visible_text(html: str) -> str:
    """The words of a page: no scripts, styles, comments, navigation, tags or entities."""
    return _TAGS.sub(" ", html)


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, key) of an address; the key is the top-level domain and a two-letter first path segment."""
    m = _URL.match(url or "")
    host = (m[1] if m else "").lower().strip(".")
    parts = host.split(".")
    first = (m[2] if m else "").split("/")[0].lower()
    return host, ".".join(parts[-2:]), f"{parts[-1]}/{first if re.fullmatch('[a-z]{2}', first) else ''}"


def features(rows: DataFrame, model: tuple[list[str], np.ndarray], html: bool) -> DataFrame:
    """id, host, domain, address, declared, n (trigrams) and text (log-likelihood of each language, scaled).

    rows: (id, text, host_or_url, declared). With html, text is a page, its
    declaration is read from it and host_or_url is a URL; otherwise
    host_or_url is the host itself.
    """
    langs, logs = model

    def one(batch: pa.RecordBatch) -> dict:
        out: dict = {"id": batch.column(0), "host": [], "domain": [], "address": [], "declared": [], "n": [], "text": []}
        for text, place, said in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            text = text or ""
            if html:
                said = declared(text)
                where = address(place)
                text = visible_text(text)
            else:
                where = (place or "", "", "")
            grams = trigrams(text)
            score = logs[:, grams].sum(axis=1) * (min(1.0, EFFECTIVE / len(grams)) if len(grams) else 0.0)
            for k, v in zip(("host", "domain", "address", "declared", "n", "text"), (*where, (said or "").lower(), len(grams), score), strict=True):
                out[k].append(v)
        return out

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "text", "host_or_url", "declared"), one, f"id {kind}, host string, domain string, address string, declared string, n long, text array<double>")


def _normal(weights: Column) -> Column:
    """Log weights to probabilities."""
    top = F.array_max(weights)
    raw = F.transform(weights, lambda w: F.exp(w - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
    return F.transform(raw, lambda w: w / total)


def _sums(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """For each value of key, the summed text posterior of each language as array s."""
    return rows.groupBy(*key).agg(F.array(*[F.round(F.sum(F.col("p")[i]), 6) for i in range(size)]).alias("s"))


def fuse(feats: DataFrame, langs: Sequence[str]) -> DataFrame:
    """id, n, lang, confidence, posterior (array, in the order of langs), declared and text of each row of features()."""
    size = len(langs)
    if not size:
        none = F.array().cast("array<double>")
        return feats.select("id", "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("posterior"), "declared", "text")
    feats = feats.withColumn("p", _normal(F.col("text")))
    total = feats.agg(F.array(*[F.sum(F.col("p")[i]) for i in range(size)])).first()[0]
    total = [float(x or 0.0) + 1.0 for x in total]
    base = [x / sum(total) for x in total]
    prior = F.array(*[F.lit(x) for x in base])
    zero = F.array(*[F.lit(0.0)] * size)

    def smoothed(s: Column, weight: float, above: Column) -> Column:
        n = F.aggregate(s, F.lit(0.0), lambda a, b: a + b)
        return F.transform(F.arrays_zip(s.alias("a"), above.alias("b")), lambda x: (x["a"] + F.lit(weight) * x["b"]) / (n + F.lit(weight)))

    hosts = _sums(feats, ["domain", "host"], size)
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("d"))
    known = lambda df, name: sized(written(df, name), MOST // size)
    hosts = known(hosts.join(domains, "domain").select("host", "domain", smoothed(F.col("s"), HOST_WEIGHT, smoothed(F.col("d"), DOMAIN_WEIGHT, prior)).alias("h")), "hosts")
    likely = lambda name, key: known(_sums(feats, [key], size).select(  # noqa: E731  P(value | language), smoothed by the value's share of all
        key, F.transform(F.arrays_zip(F.col("s").alias("a"), F.array(*[F.lit(x) for x in total]).alias("b")), lambda x: F.log((x["a"] + F.lit(TABLE_WEIGHT / size)) / (x["b"] + F.lit(TABLE_WEIGHT)))).alias(name)
    ), name)
    both = feats.join(hosts, ["domain", "host"], "left").join(likely("said", "declared"), "declared", "left").join(likely("placed", "address"), "address", "left")
    logs = F.arrays_zip(F.col("text").alias("t"), F.transform(F.coalesce(F.col("h"), prior), lambda x: F.log(x)).alias("h"), F.when(F.col("declared") == "", zero).otherwise(F.coalesce(F.col("said"), zero)).alias("s"), F.when(F.col("address") == "", zero).otherwise(F.coalesce(F.col("placed"), zero)).alias("a"))
    out = both.select("id", "n", "declared", "text", _normal(F.transform(logs, lambda x: x["t"] + x["h"] + x["s"] + x["a"])).alias("posterior"))
    best = F.array_max("posterior")
    return out.select("id", "n", F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("posterior", best).cast("int")).alias("lang"), F.round(best, 6).alias("confidence"), F.transform("posterior", lambda x: F.round(x, 6)).alias("posterior"), "declared", "text")


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, n_trigrams, lang, confidence, posterior and rejected (no posterior of SURE) of every page; docs: labelled texts."""
    model = fit_text(docs)
    feats = written(features(pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.col("url").alias("host_or_url"), F.lit(None).cast("string").alias("declared")), model, True), "langid")
    return fuse(feats, model[0]).select(F.col("id").alias("page_id"), F.col("n").alias("n_trigrams"), "lang", "confidence", "posterior", (F.coalesce(F.col("confidence") < SURE, F.col("n") == 0)).alias("rejected"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n, lang, confidence, posterior and rejected of every document; its source is its host, its lang column the declaration.

    Rejected are documents without letters, those without a posterior of SURE,
    and those that declare a language of the model but are of another: at
    least LONG trigrams whose mean log-likelihood is FITS or more in the
    language found (texts of no known language have far less) and MARGIN more
    than in the declared one.
    """
    langs, logs = fit_text(docs)
    feats = written(features(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("host_or_url"), F.col("lang").alias("declared")), (langs, logs), False), "langid")
    out = fuse(feats, langs)
    names = F.array(*[F.lit(x) for x in langs]) if langs else F.array(F.lit(""))
    mean = lambda lang: F.try_element_at(F.col("text"), F.array_position(names, lang).cast("int")) / EFFECTIVE
    other = F.array_contains(names, F.col("declared")) & (F.col("declared") != F.col("lang"))
    wrong = F.when(other & (F.col("n") >= LONG), (mean(F.col("lang")) >= FITS) & (mean(F.col("lang")) - mean(F.col("declared")) >= MARGIN)).otherwise(F.lit(False))
    rejected = (F.col("n") == 0) | F.coalesce(F.col("confidence") < SURE, F.lit(False)) | F.coalesce(wrong, F.lit(True))
    return out.select(F.col("id").alias("doc_id"), "n", "lang", "confidence", "posterior", rejected.alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those that identify_documents() rejects.

    One pass over the texts scores them; they are matched again by id, so
    rows of the same id share the fate of the best of them. Null ids match
    each other.
    """
    found = identify_documents(docs).where("not rejected").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_semi")
