"""Zip containers as tables: entries, package parts, relationships and sheet cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "doc_id long, name string, size long, compressed long, encrypted boolean"
PARTS = "doc_id long, part string, content_type string, size long"
RELS = "doc_id long, part string, rel_id string, type string, target string"
CELLS = "doc_id long, sheet string, row int, col int, value_type string, value_data string, formula string"


def _table(df: DataFrame, id_col: str, data_col: str, schema: str, rows: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Rows of every readable container; damaged ones give none (``documents.docs`` names their error)."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for i, data in zip(pdf["doc_id"], pdf["data"], strict=True):
                try:
                    found += [(i, *r) for r in rows(bytes(data))]
                except Exception:
                    continue
            yield pd.DataFrame(found, columns=names)

    ready = df.where(F.col(id_col).isNotNull() & F.col(data_col).isNotNull())
    return ready.select(F.col(id_col).cast("long").alias("doc_id"), F.col(data_col).alias("data")).mapInPandas(run, schema)


def zip_entries(df: DataFrame, id_col: str = "doc_id", data_col: str = "content") -> DataFrame:
    from ..sources.containers import entries

    return _table(df, id_col, data_col, ENTRIES, entries)


def package_parts(df: DataFrame, id_col: str = "doc_id", data_col: str = "content") -> DataFrame:
    """Parts of office packages with their content types."""

    def rows(data: bytes) -> list[tuple]:
        from ..sources.containers import Package

        p = Package(data)
        return [(n, p.content_type(n), p.zip.getinfo(n).file_size) for n in sorted(p.names) if not n.endswith("/")]

    return _table(df, id_col, data_col, PARTS, rows)


def relationships(df: DataFrame, id_col: str = "doc_id", data_col: str = "content") -> DataFrame:
    """Relationships of every part; those of the package itself have the part ``""``."""

    def rows(data: bytes) -> list[tuple]:
        from ..sources.containers import Package

        p = Package(data)
        return [(part, i, kind, target) for part in ["", *sorted(p.names)] for i, (kind, target) in p.rels(part).items()]

    return _table(df, id_col, data_col, RELS, rows)


def broken_relationships(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationships to parts that are not there; links to the outside are none of these."""
    have = parts.select("doc_id", F.col("part").alias("target"))
    return rels.where(~F.col("target").rlike("^[a-z]+:") & (F.col("type") != "hyperlink")).join(have, ["doc_id", "target"], "left_anti")


def sheet_cells(df: DataFrame, id_col: str = "doc_id", data_col: str = "content") -> DataFrame:
    """One row per cell that has a value; rows and columns count from 1 within the used rectangle."""

    def rows(data: bytes) -> list[tuple]:
        from ..sources.containers import xlsx

        out = []
        for sheet in xlsx(data).root.children:
            for r, row in enumerate(sheet.children, 1):
                for c, cell in enumerate(row.children, 1):
                    p = cell.props
                    if p.get("value:type"):
                        out.append((sheet.props.get("title"), r, c, p["value:type"], p.get("value:data"), p.get("value:formula")))
        return out

    return _table(df, id_col, data_col, CELLS, rows)
