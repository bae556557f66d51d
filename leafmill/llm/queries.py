"""The thin queries: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup as _exact
from . import license_scan as _license
from . import mixing as _mixing
from . import packing as _packing
from . import paragraph_dedup as _paragraphs
from . import permutation_index as _index
from . import sharding as _sharding
from . import simhash as _simhash
from . import suffix_dedup as _suffix
from . import toxicity as _toxicity
from ._shared import table


def op1_paragraph_dedup(spark, sf_dir):
    return _paragraphs.paragraph_dedup(table(spark, sf_dir, "documents"), cover=True)


def op2_suffix_dedup(spark, sf_dir):
    return _suffix.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_sharding(spark, sf_dir):
    return _sharding.shard(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return _toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return _packing.pack(table(spark, sf_dir, "documents"))


def op6_permutation_index(spark, sf_dir):
    return _index.nearest(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark, sf_dir):
    return _license.license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # In this table every document has one source; a null source is one too.
    return _mixing.mix(docs.select("doc_id", "text", F.array("source").alias("sources")))


def op10_simhash(spark, sf_dir):
    return _simhash.simhash_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_paragraph_dedup": op1_paragraph_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_permutation_index": op6_permutation_index,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
}

#: Only exact deduplication can be said in SQL; the others rest on hashes,
#: models, tokenizers or sequential packing and are tested by brute force.
ORACLE_SQL = {
    "op8_exact_dedup": _exact.ORACLE,
}
