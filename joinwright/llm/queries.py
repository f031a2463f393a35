"""The registered query of each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.bpe import encode_documents
from joinwright.llm.chat import rotate_perspectives
from joinwright.llm.exact_dedup import exact_duplicates
from joinwright.llm.licenses import license_report
from joinwright.llm.mixing import Mixture
from joinwright.llm.secrets import secret_report
from joinwright.llm.simhash import hex_fingerprint, near_duplicates
from joinwright.llm.topk import top_k
from joinwright.llm.toxicity import score_toxicity, train
from joinwright.llm.urls import filter_urls
from joinwright.llm.workspace import table

#: A toxic text is of grade 1, one of poor quality of grade 2.
GRADE = "toxic * (2 - coalesce(quality, 1))"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages")).withColumnRenamed("id", "page_id")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"), GRADE)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_report(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_duplicates(table(spark, folder, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), VOCABULARY, with_ids=False).withColumnRenamed("id", "doc_id")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return Mixture(table(spark, folder, "documents")).taken().withColumnRenamed("id", "doc_id")


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    found = rotate_perspectives(table(spark, folder, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("conv_id", "speaker", "part", "n_turns", "text", masks.alias("masks"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_report(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_topk": op6_topk,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
""",
    "op9_chat": """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS raw FROM conversations),
u AS (SELECT *, replace(raw, '<|', '<\\|') || '<|end|>' || chr(10) AS body,
             CASE WHEN role = 'system' THEN '<|system|>' ELSE '<|user:' || replace(replace(role, '<|', '<\\|'), '|>', '|\\>') || '|>' END || chr(10) AS other FROM t),
b AS (SELECT *, row_number() OVER w AS k, CAST(floor((sum(length(other) + length(body)) OVER w - length(other) - length(body)) / 1048576) AS BIGINT) AS part FROM u
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, sha256(raw) ROWS UNBOUNDED PRECEDING)),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
e AS (SELECT b.*, s.speaker, CASE WHEN b.role = s.speaker THEN '<|assistant|>' || chr(10) ELSE other END AS head FROM b JOIN s ON b.conv_id = s.conv_id),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(CAST(upto - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE role = speaker), '') AS masks
FROM p GROUP BY conv_id, speaker, part
""",
}
