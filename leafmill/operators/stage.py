"""Write an intermediate table once to storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back.

    What is used several times is computed once, and survives lost executors.
    Only where no folder is set (local sessions) a temporary one is made.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not held.isDefined() and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/leafmill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt by ``doc_id`` and sorted by it and ``order``, for a walk over whole documents.

    A walk does not tell Spark that it needs documents whole.  Dealt by the
    bare column, the exchange is left out where the input is dealt so already,
    and the adaptive plan may then cut that one's partitions differently (in
    each branch of a union).  Nothing else is dealt by this hash.
    """
    return df.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", *order)
