"""The corpus pipeline: documents in, training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet and reread as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, mixing, packing, simhash, toxicity
from leafmill.llm._shared import drop_rows, fold_case, settle, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the chain finds toxic.

    Null, empty and unlabelled texts are scored like any other; repeated rows
    get one verdict; without labels of both kinds nothing or all is toxic by
    the prior alone, and an empty table stays empty.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    return docs.where(toxicity.probability(F.col("text"), chain, "toxic") < 0.5)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest id of each group of equal texts.

    Null and empty texts are one group; rows that repeat an id with the same
    text stay or go together; a row with a null id goes if its text has an id.
    """
    gone = exact_dedup.exact_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_mark"))
    digest = F.unhex(F.sha2(fold_case(F.col("text")).cast("binary"), 256))
    return drop_rows(docs, gone, "doc_id", digest, "pipeline-exact")


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one of the smallest id, of each group of near copies.

    Rows with a null id stay; null and wordless texts are equal to each other;
    texts of a repeated id are judged one by one.
    """
    groups = simhash.near_copies(docs)
    gone = groups.where(~F.col("kept")).select(F.col("node").alias("_id"), F.col("text_hash").alias("_mark"))
    return drop_rows(docs, gone, "doc_id", F.xxhash64("text"), "pipeline-near")


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; documents not taken go.

    A null source is a source; a null text has no words and comes as often as
    its place in the seeded order says; rows of equal id and source are taken
    together.
    """
    return mixing.repeat_by_mix(docs, F.array("source"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents' tokens into sequences of 2048; null and empty texts are just their end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact),
    ("simhash_near_dedup", _near),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: SQL cannot express the stages' models, hashes and tokenizers; they are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
