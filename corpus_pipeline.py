"""From documents to token ids: toxic texts go, exact and near copies go, sources are mixed, texts are encoded.

Each stage is written as Parquet and reread as the next one's input. All stages
but the last return the columns of ``documents``; the mix repeats rows as its
targets ask.

Defined cases: null texts count as empty, so that of all empty texts one stays;
a null id is an id like any other to ``exact_dedup`` (it stays only where its
group has no other), and its row is never dropped as a near copy; very long
texts are worked on whole; of repeated rows one stays; an empty table gives an
empty table at each stage; further columns are kept up to the mix, whatever
they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.bpe import encode_documents
from joinwright.llm.exact_dedup import drop_exact_duplicates
from joinwright.llm.mixing import Mixture
from joinwright.llm.queries import GRADE, VOCABULARY
from joinwright.llm.simhash import keep_one_of_each
from joinwright.llm.toxicity import drop_toxic, train
from joinwright.llm.workspace import Workspace, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels"), GRADE))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Mixture(docs).mixed()


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, VOCABULARY).select(F.col("id").alias("doc_id"), "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Trained weights and the splitting tree's draws are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
