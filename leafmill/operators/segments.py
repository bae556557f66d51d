"""Segmentation by headings and other sequence logic, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(df: DataFrame, doc: str, order: str, starts: Column) -> DataFrame:
    """Add ``chunk``: a new one begins at each row that ``starts``, unless the current one is empty."""
    w = Window.partitionBy(doc).orderBy(order)
    begun = F.coalesce(starts, F.lit(False))
    first = F.row_number().over(w) == 1
    return df.withColumn("chunk", F.sum((begun & ~first).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def slides(df: DataFrame, doc: str, order: str, starts: Column) -> DataFrame:
    """Add ``slide`` from 1; rows before the first start are dropped."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("slide", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w).cast("int")).where("slide > 0")


def table_of_contents(df: DataFrame, doc: str, order: str, level: Column, title: Column) -> DataFrame:
    """Heading rows with the chunk they fall in: the number of level-1 headings so far, from 0."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum((level == 1).cast("int")).over(w)
    return (
        df.withColumn("toc_level", level)
        .withColumn("toc_title", title)
        .withColumn("chunk", (F.greatest(F.coalesce(so_far, F.lit(0)), F.lit(1)) - 1).cast("int"))
        .where(F.col("toc_level").isNotNull())
    )


def numbered(df: DataFrame, parent: list[str], order: list[str], start: int = 1) -> DataFrame:
    """Add ``item_no``: list numbers from ``start`` within each parent."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return df.withColumn("item_no", (F.row_number().over(w) + start - 1).cast("int"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their ``rank``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
