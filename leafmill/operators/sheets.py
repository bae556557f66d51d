"""Lookups of spreadsheets as joins: strings, widths, merged ranges, names and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_shared_strings(cells: DataFrame, strings: DataFrame, index: str, key: str, text: str) -> DataFrame:
    """Add ``shown``: the string a cell points to, or a reference error."""
    held = strings.select(F.col(key).alias(index), F.col(text).alias("_s"))
    return cells.join(held, index, "left").withColumn("shown", F.coalesce("_s", F.lit("Error: #REF!"))).drop("_s")


def with_widths(cells: DataFrame, ranges: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Add ``width_id``: the first range (by ``id``) with ``first <= col <= last``; null without one.

    ``ranges`` is ``(id, first, last)`` and ``keys``.  A sheet has at most
    16,384 columns, so the ranges are written out and the join is an equi-join.
    """
    keys = keys or []
    per = ranges.where("first <= last").select(*keys, F.col("id"), F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("_c"))
    first = per.groupBy(*keys, "_c").agg(F.min("id").alias("width_id"))
    return cells.withColumn("_c", F.col(col).cast("int")).join(first, [*keys, "_c"], "left").drop("_c")


def with_merges(cells: DataFrame, merges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``row_span`` and ``col_span`` to the top-left cells of merged ranges, null to the others.

    ``merges`` is ``(r1, c1, r2, c2)``, ``cells`` has ``row`` and ``col``.
    """
    keys = keys or []
    spans = merges.select(
        *keys, F.col("r1").alias("row"), F.col("c1").alias("col"),
        (F.col("r2") - F.col("r1") + 1).alias("row_span"), (F.col("c2") - F.col("c1") + 1).alias("col_span"),
    )
    return cells.join(spans, [*keys, "row", "col"], "left")


def dimensions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """First and last row and column in use, per sheet."""
    return cells.groupBy(*keys).agg(
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col")
    )


def resolve_names(uses: DataFrame, names: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``refers_to``: a name of the use's own ``sheet``, else the one without sheet; case does not count."""
    keys = keys or []
    held = names.withColumn("_n", F.lower("name")).groupBy(*keys, "_n", "sheet").agg(F.min("refers_to").alias("_r"))
    own = held.where("sheet IS NOT NULL").withColumnRenamed("_r", "_own")
    common = held.where("sheet IS NULL").drop("sheet").withColumnRenamed("_r", "_common")
    asked = uses.withColumn("_n", F.lower("name")).join(own, [*keys, "_n", "sheet"], "left").join(common, [*keys, "_n"], "left")
    return asked.withColumn("refers_to", F.coalesce("_own", "_common")).drop("_n", "_own", "_common")


def rules_at(cells: DataFrame, rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells with each rule (``rule, r1, c1, r2, c2``) whose range they lie in.

    Ranges are filed under tiles of 64 by 64 cells; a cell meets only the
    ranges of its own tile, so this is an equi-join with a filter.
    """
    keys = keys or []
    tile = lambda c: F.floor(F.col(c) / 64).cast("int")
    filed = rules.withColumn("_tr", F.explode(F.sequence(tile("r1"), tile("r2")))).withColumn("_tc", F.explode(F.sequence(tile("c1"), tile("c2"))))
    met = cells.withColumn("_tr", tile("row")).withColumn("_tc", tile("col")).join(filed, [*keys, "_tr", "_tc"])
    return met.where("row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2").drop("_tr", "_tc", "r1", "c1", "r2", "c2")


def pivot(rows: DataFrame, by: str, across: str, values: list[str], value: str) -> DataFrame:
    """Sums of ``value`` by row label and the column labels named; absent cells are 0."""
    wide = rows.groupBy(by).pivot(across, values).agg(F.sum(value))
    return wide.na.fill(0, values)


def text_width(value: Column) -> Column:
    """Width of a text in bytes, as padded tables count it."""
    return F.coalesce(F.octet_length(value), F.lit(0))
