"""A corpus from raw documents to padded batches: five operators, each on all that the one before kept.

Every stage takes and returns the columns of documents (doc_id, text, lang,
source, n_chars), but for the last, which returns the batches. A stage's own
intermediate tables are deleted when a later stage begins: by then its result
has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinloom.llm import jaccard, langid, mixing, packing, suffixes
from twinloom.llm.common import table, tag_scratch, written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    tag_scratch(spark, "stage", drop=True)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of five-word shingle sets of Jaccard 0.8 or more."""
    tag_scratch(spark, "stage", drop=True)
    return jaccard.keep_one(docs, 5, (80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes or more that came earlier out of the texts."""
    tag_scratch(spark, "stage", drop=True)
    return suffixes.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their sources' target weights ask for."""
    tag_scratch(spark, "stage", drop=True)
    return mixing.mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding, and batches in them."""
    tag_scratch(spark, "stage", drop=True)
    return packing.pack(docs)


STAGES = [("language_id", identify), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("mixing", mix_sources), ("packing", pack_batches)]
#: The stages hold dynamic programmes and a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        tag_scratch(spark, "pipeline")
        docs = written(docs, f"stage-{name}")
    return docs
