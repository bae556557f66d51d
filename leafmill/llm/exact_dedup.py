"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``)
names the digests that may be frequent.  Their exact counts are verified, the
verified winners -- at most ``tracked`` rows of fixed width, whatever the
input -- are broadcast and remove their copies on the map side; all other
digests, none of which can be frequent, take an ordinary shuffle.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fold_case, settle


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tracked: int = 8192,
    heavy: int = 64,
) -> DataFrame:
    """Group rows whose texts agree after lower-casing A-Z; the largest id stays.

    Returns ``(<id_col>, keep_id, group_size, kept, text_sha256)``, one row
    per input row.  Texts are compared by the SHA-256 of their normalised
    UTF-8 bytes.

    Defined cases: a null text equals an empty one; a null id never beats
    another id, and in a group of null ids only ``keep_id`` is null and every
    row is kept; rows that repeat an id with the same text are one document
    and are flagged alike; an empty table gives an empty result; other
    columns are not read.

    A sketch of ``tracked`` counters finds every digest whose share of the
    rows is above its error, a small multiple of ``1/tracked``.  Those with
    at least ``heavy`` rows are broadcast, ``tracked`` rows at most; the
    others, of a lesser share each, are shuffled.
    """
    digest = F.sha2(fold_case(F.col(text_col)).cast("binary"), 256)
    rows = settle(
        docs.select(F.col(id_col).alias("_id"), F.unhex(digest).alias("_digest")).withColumn(
            "_key", F.xxhash64("_digest")
        ),
        "exact",
    )
    likely = rows.agg(F.expr(f"approx_top_k(_key, {tracked}, {tracked})").alias("_top")).select(
        F.explode(F.col("_top.item")).alias("_key")
    )
    winners = settle(
        rows.join(F.broadcast(likely), "_key", "left_semi")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_n"))
        .where(F.col("_n") >= heavy)
        .orderBy(F.col("_n").desc(), "_digest")
        .limit(tracked),
        "exact-winners",
    )
    small = F.broadcast(winners)
    frequent = rows.join(small, "_digest")
    w = Window.partitionBy("_digest")
    ordinary = rows.join(small.select("_digest"), "_digest", "left_anti").select(
        "_digest",
        "_id",
        "_key",
        F.max("_id").over(w).alias("_keep"),
        F.count("*").over(w).alias("_n"),
    )
    return frequent.unionByName(ordinary).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
