"""Tree transforms as relational rewrites of the ``nodes`` table.

Every transform takes and returns a ``nodes`` DataFrame.  All joins and
windows are keyed by ``doc_id``, so one hash partitioning serves a whole chain
of transforms; parsers emit whole documents, so it is often there already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import settle

#: White space as the Unicode property has it, for trimming.
BLANK = r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$"
COLUMNS = ["doc_id", "node_id", "parent_id", "ordinal", "depth", "last_desc", "kind", "content", "level", "props"]


def shift_headings(nodes: DataFrame, delta: int, least: int = 1, most: int = 6) -> DataFrame:
    """Add ``delta`` to heading levels, clamped; headings without a level stay as they are."""
    moved = F.greatest(F.lit(least), F.least(F.lit(most), F.col("level") + delta))
    is_heading = (F.col("kind") == "heading") & F.col("level").isNotNull()
    out = nodes.withColumn("level", F.when(is_heading, moved).otherwise(F.col("level")).cast("int"))
    if "props" in nodes.columns:
        fixed = F.regexp_replace("props", r'"level": ?-?\d+', F.concat(F.lit('"level": '), F.col("level").cast("string")))
        out = out.withColumn("props", F.when(is_heading, fixed).otherwise(F.col("props")))
    return out


def _keep(nodes: DataFrame, flag) -> DataFrame:
    """Only rows with ``flag``, renumbered.

    A dropped row must be a leaf or have one child.  A run of dropped rows is
    then a chain in which each is the parent of the next, so a child of a
    dropped row belongs to the parent of its run's first row.  A running count
    of kept rows gives new numbers, and the same count at the old end of a
    subtree gives its new end.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("node_id")
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag(F.struct("_keep", "node_id")).over(by_doc)
    inner = ~F.col("_keep") & (F.col("last_desc") > F.col("node_id"))
    counted = (
        nodes.withColumn("_keep", flag)
        .withColumn("_before", before)
        .withColumn("_new", F.sum(F.col("_keep").cast("int")).over(upto).cast("int") - 1)
        .withColumn("_top", F.when(inner & F.coalesce(F.col("_before._keep"), F.lit(True)), F.col("parent_id")))
        .withColumn(
            "_up",
            F.when(
                ~F.coalesce(F.col("_before._keep"), F.lit(True)) & (F.col("_before.node_id") == F.col("parent_id")),
                F.last("_top", ignorenulls=True).over(upto),
            ).otherwise(F.col("parent_id")),
        )
    )
    counted = settle(counted.drop("_before", "_top"), "nodes")
    # Rows lose a level for each dropped row whose interval they are in.
    ends = (
        counted.where(inner)
        .groupBy("doc_id", (F.col("last_desc") + 1).alias("node_id"))
        .agg(F.count("*").alias("_closed"))
    )
    leveled = counted.join(ends, ["doc_id", "node_id"], "left").withColumn(
        "_lost", F.sum(inner.cast("int") - F.coalesce("_closed", F.lit(0))).over(upto)
    )
    at = counted.select("doc_id", F.col("node_id").alias("last_desc"), F.col("_new").alias("_end"))
    up = counted.select("doc_id", F.col("node_id").alias("_up"), F.col("_new").alias("_parent"))
    kept = leveled.where("_keep").join(at, ["doc_id", "last_desc"]).join(up, ["doc_id", "_up"], "left")
    siblings = Window.partitionBy("doc_id", "_parent").orderBy("node_id")
    return kept.select(
        "doc_id",
        F.col("_new").alias("node_id"),
        F.col("_parent").alias("parent_id"),
        (F.row_number().over(siblings) - 1).alias("ordinal"),
        (F.col("depth") - F.col("_lost")).cast("int").alias("depth"),
        F.col("_end").alias("last_desc"),
        *[c for c in nodes.columns if c not in COLUMNS[:6]],
    )


def strip_empty(nodes: DataFrame) -> DataFrame:
    """Drop blank text and childless paragraphs, spans and divs.

    One pass from the top: a paragraph that this very pass empties survives.
    The root is never dropped.
    """
    empty = (F.col("kind") == "text") & F.coalesce(F.col("content").rlike(BLANK), F.lit(True))
    hollow = F.col("kind").isin("paragraph", "span", "div") & (F.col("last_desc") == F.col("node_id"))
    return _keep(nodes, (F.col("node_id") == 0) | ~(empty | hollow))


def merge_text(nodes: DataFrame) -> DataFrame:
    """Concatenate runs of text siblings into the first, whose other properties stay."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("ordinal")
    is_text = F.col("kind") == "text"
    marked = nodes.withColumn(
        "_first", is_text & ~F.coalesce(F.lag("kind").over(siblings) == "text", F.lit(False))
    ).withColumn("_run", F.sum((F.col("_first") | ~is_text).cast("int")).over(siblings))
    run = Window.partitionBy("doc_id", "parent_id", "_run").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = marked.withColumn(
        "content",
        F.when(is_text, F.concat_ws("", F.collect_list(F.coalesce("content", F.lit(""))).over(run))).otherwise(F.col("content")),
    )
    return _keep(joined.drop("_run"), F.col("_first") | ~is_text).drop("_first")


def unwrap_single_child(nodes: DataFrame) -> DataFrame:
    """Replace a div or span that has one child and no properties by that child; chains collapse."""
    only = nodes.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("_n")).where("_n = 1 AND node_id IS NOT NULL")
    bare = F.coalesce(F.col("props"), F.lit("{}")).isin("{}", "null") if "props" in nodes.columns else F.lit(True)
    joined = nodes.join(only, ["doc_id", "node_id"], "left")
    doomed = F.col("kind").isin("div", "span") & bare & F.col("_n").isNotNull() & (F.col("node_id") != 0)
    flagged = joined.withColumn("_go", F.coalesce(doomed, F.lit(False))).drop("_n")
    return _keep(flagged, ~F.col("_go")).drop("_go").select(*nodes.columns)


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One transform from several, applied in order."""

    def run(nodes: DataFrame) -> DataFrame:
        for s in steps:
            nodes = nodes.transform(s)
        return nodes

    return run


def ancestors(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """``(doc_id, node_id, ancestor_id, ancestor_kind)`` pairs, by interval."""
    a = nodes.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("last_desc").alias("_l"), F.col("kind").alias("ancestor_kind"))
    a = a.where(F.col("ancestor_kind") == kind) if kind else a
    return (
        nodes.select("doc_id", "node_id")
        .join(a, "doc_id")
        .where("ancestor_id < node_id AND node_id <= _l")
        .drop("_l")
    )
