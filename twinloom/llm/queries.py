"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import chat, jaccard, langid, media, mixing, packing, search, suffixes, tokenids, toxicity
from twinloom.llm.common import table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each one whose id is divisible by 20."""
    return search.top_k(table(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(20)) == 0).withColumn("score", F.round("score", 4))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(written(media.encode_media(table(spark, sf_dir, "documents")), "media"), arrays=False)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.link(*chat.turns_as_calls(turns), chat.REPLY, chat.turns_as_dependencies(turns))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.read_files(tokenids.write_files(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_topk_search": op3_topk_search,
    "op4_media": op4_media,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_chat": op7_chat,
    "op8_token_ids": op8_token_ids,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_TEXT = "coalesce('\"' || " + _ESCAPED.format("text") + " || '\"', 'null')"
_QUOTED_ARGUMENTS = "'{\"prompt\":' || " + _TEXT + " || ',\"turn\":' || turn || '}'"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": rf"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')) AS t FROM documents
), e AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS n FROM e GROUP BY ALL),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT t, ln(1 + (g.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM e, g GROUP BY t, g.n),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(f.idf * q.tf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.n / g.mean))), 6) AS score
  FROM e q JOIN e d USING (t) JOIN f USING (t) JOIN l ON l.doc_id = d.doc_id, g
  WHERE q.doc_id % 20 = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10
""",
    "op7_chat": f"""
WITH RECURSIVE calls AS (
  SELECT DISTINCT conv_id, turn, CASE WHEN turn // 2 >= 1 THEN 2 * ((turn // 2 - 1) // 2) + turn % 2 END AS on_turn FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL
), depths AS (
  SELECT conv_id, turn, 0 AS depth FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls o WHERE o.conv_id = c.conv_id AND o.turn = c.on_turn)
  UNION ALL SELECT c.conv_id, c.turn, d.depth + 1 FROM calls c JOIN depths d ON d.conv_id = c.conv_id AND d.turn = c.on_turn
), items AS (
  SELECT conv_id, turn, 0 AS k, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status, 0 AS depth,
         '{{"content":' || {_TEXT} || ',"role":"' || role || '","turn":' || turn || ',"type":"message"}}' AS json
  FROM conversations WHERE role NOT IN ('user', 'assistant')
  UNION ALL
  SELECT conv_id, turn, 1, 'call', 'c' || turn,
         CASE WHEN text IS NULL THEN 'type of prompt'
              WHEN EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn = c.turn + 1) THEN 'ok' ELSE 'no result' END, depth,
         '{{"arguments":' || {_QUOTED_ARGUMENTS} || ',"id":"c' || turn || '","name":"reply","type":"call"}}'
  FROM conversations c JOIN depths USING (conv_id, turn) WHERE role = 'user'
  UNION ALL
  SELECT r.conv_id, r.turn, 2, 'result', 'c' || (r.turn - 1),
         CASE WHEN depth IS NULL THEN 'no call' WHEN row_number() OVER (PARTITION BY r.conv_id, r.turn ORDER BY text NULLS FIRST) = 1 THEN 'linked' ELSE 'repeated' END, coalesce(depth, 0),
         '{{"content":' || {_TEXT} || ',"id":"c' || (r.turn - 1) || '","type":"result"}}'
  FROM conversations r LEFT JOIN depths d ON d.conv_id = r.conv_id AND d.turn = r.turn - 1 WHERE role = 'assistant'
)
SELECT conv_id, turn, kind, call_id, status, CAST(depth AS INTEGER) AS depth, json,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn, depth, k, call_id, json) - 1 AS position
FROM items
""",
}
