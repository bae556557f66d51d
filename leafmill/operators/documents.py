"""Documents to ``nodes``: parsers over tables, and line trees without a parser."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DOCS, NODES, WARNINGS, flatten
from .stage import gathered

_NAMES = [c.split(" ")[0] for c in NODES.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


#: What a worker hands on at a time: so many rows, or rows of so many characters of source.
#: It holds one batch of sources and this, however many documents a batch has.
ROWS, CHARS = 5_000, 4_000_000


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of tuples under a schema of scalar columns."""
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def in_batches(parsed: Iterable[tuple[int, list[tuple]]], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` rows from ``(size of the source, rows)`` of one document after the other."""
    held: list[tuple] = []
    chars = 0
    for size, rows in parsed:
        held += rows
        chars += size
        while len(held) >= ROWS or (held and chars >= CHARS):
            yield record_batch(held[:ROWS], schema)
            del held[:ROWS]
            chars = chars if len(held) >= ROWS else 0
    if held:
        yield record_batch(held, schema)


def per_document(df: DataFrame, id_col: str, source_col: str, schema: str, make: Callable[[int, object], list[tuple]]) -> DataFrame:
    """``make(doc_id, source)`` of every row of ``df`` that has an id, one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed():
            for batch in batches:
                ids, sources = batch.columns
                for i, source in zip(ids, sources, strict=True):
                    source = source.as_py()
                    yield len(source or ""), make(i.as_py(), source)

        yield from in_batches(parsed(), schema)

    return (
        df.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"))
        .mapInArrow(run, schema)
    )


def nodes(df: DataFrame, fmt: str, id_col: str, source_col: str, columns: tuple[str, ...] = tuple(_NAMES)) -> DataFrame:
    """Parse every row of ``df`` and return its ``nodes`` rows.

    The parser emits whole documents, so one document's rows are born in one
    partition.  Rows with a null id are not read; a null source is empty.
    Only the ``columns`` asked for are made and leave the worker.
    """
    at = [_NAMES.index(c) for c in columns]
    props = "props" in columns

    def make(i, source):
        from ..sources.registry import parse

        try:
            rows = flatten(i, parse(fmt, source).root, props)
        except Exception:  # a failed document is a row of docs(), not of nodes()
            return []
        return rows if len(at) == len(_NAMES) else [tuple([r[k] for k in at]) for r in rows]

    return per_document(df, id_col, source_col, ", ".join(NODES.split(", ")[k] for k in at), make)


def docs(df: DataFrame, fmt: str, id_col: str, source_col: str) -> DataFrame:
    """One row per document: metadata as JSON, or the category of its error."""

    def make(i, source):
        from ..sources.registry import categorize, parse

        try:
            d = parse(fmt, source)
            return [(i, fmt, True, None, None, json.dumps(d.metadata, ensure_ascii=False, sort_keys=True))]
        except Exception as e:
            return [(i, fmt, False, categorize(e), str(e), None)]

    return per_document(df, id_col, source_col, DOCS, make)


def warnings(df: DataFrame, fmt: str, id_col: str, source_col: str) -> DataFrame:
    """Fidelity warnings of parsing, one row each."""

    def make(i, source):
        from ..model import SEVERITIES
        from ..sources.registry import parse

        try:
            found = parse(fmt, source).warnings
        except Exception:
            return []
        return [(i, "parse", w.severity, SEVERITIES.index(w.severity), w.kind, w.detail, w.message) for w in found]

    return per_document(df, id_col, source_col, WARNINGS, make)


def emit(nodes_df: DataFrame, fmt: str, docs_df: DataFrame | None = None) -> DataFrame:
    """``(doc_id, output)``: every document written in ``fmt``, as bytes; text formats are UTF-8.

    ``docs_df`` (``doc_id``, ``metadata`` as JSON) gives titles and the like;
    without it documents have none.
    """

    if docs_df is None:
        held = nodes_df.withColumn("_metadata", F.lit(None).cast("string"))
    else:
        # Metadata travels on the root row alone.
        roots = docs_df.select(F.col("doc_id"), F.col("metadata").alias("_metadata"), F.lit(0).alias("node_id"))
        held = nodes_df.join(roots, ["doc_id", "node_id"], "left")

    def make(rows: list[dict]) -> list[tuple]:
        from ..model import Document, rebuild

        doc = Document(rebuild(rows))
        metadata = [r["_metadata"] for r in rows if r["_metadata"] is not None]
        if metadata:
            doc.metadata = json.loads(metadata[0])
        return [(rows[0]["doc_id"], _written(fmt, doc))]

    return per_group(held, make, "doc_id long, output binary")


def _written(fmt: str, doc) -> bytes:
    from ..sinks import write

    out = write(fmt, doc)
    return out.encode("utf-8", "replace") if isinstance(out, str) else bytes(out)


def per_group(nodes_df: DataFrame, make: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``make(rows)`` of every document's rows; a worker holds one document and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            held: list[dict] = []
            for batch in batches:
                for start in range(0, batch.num_rows, 1_000):
                    for row in batch.slice(start, 1_000).to_pylist():
                        if held and row["doc_id"] != held[0]["doc_id"]:
                            yield sum(len(r["props"] or "") for r in held), make(held)
                            held = []
                        held.append(row)
            if held:
                yield 0, make(held)

        yield from in_batches(made(), schema)

    return gathered(nodes_df).mapInArrow(run, schema)


def convert(df: DataFrame, fmt: str, to: str, id_col: str, source_col: str) -> DataFrame:
    """``emit(nodes(df, fmt, ...), to)`` in one pass: trees go from the reader to the writer, none is shuffled.

    Ids are those of documents: of two rows with one id each gives a row.
    """

    def make(i, source):
        from ..model import Document, rebuild
        from ..sources.registry import parse

        try:
            rows = flatten(i, parse(fmt, source).root)
        except Exception:  # as in nodes()
            return []
        return [(i, _written(to, Document(rebuild(dict(zip(_NAMES, r, strict=True)) for r in rows))))]

    return per_document(df, id_col, source_col, "doc_id long, output binary", make)


def line_nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tree per text without a parser: one paragraph per line, with its text below."""
    lines = df.select(
        F.col(id_col).alias("doc_id"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_i", "content"),
        F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_n"),
    )
    i = F.col("_i")
    none = F.lit(None)
    pair = F.explode(
        F.array(
            F.struct((2 * i + 1).alias("node_id"), F.lit(0).alias("parent_id"), i.alias("ordinal"), F.lit(1).alias("depth"), (2 * i + 2).alias("last_desc"), F.lit("paragraph").alias("kind"), none.cast("string").alias("content")),
            F.struct((2 * i + 2).alias("node_id"), (2 * i + 1).alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(2).alias("depth"), (2 * i + 2).alias("last_desc"), F.lit("text").alias("kind"), F.col("content").alias("content")),
        )
    )
    body = lines.select("doc_id", pair.alias("r")).select("doc_id", "r.*")
    root = lines.where("_i = 0").select(
        "doc_id", F.lit(0).alias("node_id"), none.cast("int").alias("parent_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("depth"),
        (2 * F.col("_n")).alias("last_desc"), F.lit("document").alias("kind"), none.cast("string").alias("content"),
    )
    return root.unionByName(body).withColumn("level", none.cast("int")).withColumn("props", F.lit("{}"))


def turn_nodes(df: DataFrame) -> DataFrame:
    """A tree per conversation: a heading of the role and a div of three texts for every turn.

    Rows of ``df`` are ``(conv_id, turn, role, text)``; turns count in order.
    Levels run from 1 to 6 with the turn.
    """
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    n = F.count("*").over(Window.partitionBy("conv_id"))
    t = df.select("conv_id", "turn", "role", "text", k.alias("k"), n.cast("int").alias("n"))
    b = 6 * F.col("k") + 1
    row = lambda node, parent, ordinal, depth, last, kind, content=None, level=None: F.struct(
        node.alias("node_id"), parent.alias("parent_id"), ordinal.cast("int").alias("ordinal"), F.lit(depth).alias("depth"), last.alias("last_desc"),
        F.lit(kind).alias("kind"), (content if content is not None else F.lit(None)).cast("string").alias("content"),
        (level if level is not None else F.lit(None)).cast("int").alias("level"),
    )
    rows = F.explode(
        F.array(
            row(b, F.lit(0), 2 * F.col("k"), 1, b + 1, "heading", level=F.col("k") % 6 + 1),
            row(b + 1, b, F.lit(0), 2, b + 1, "text", F.col("role")),
            row(b + 2, F.lit(0), 2 * F.col("k") + 1, 1, b + 5, "div"),
            row(b + 3, b + 2, F.lit(0), 2, b + 3, "text", F.col("role")),
            row(b + 4, b + 2, F.lit(1), 2, b + 4, "text", F.lit(": ")),
            row(b + 5, b + 2, F.lit(2), 2, b + 5, "text", F.col("text")),
        )
    )
    body = t.select(F.col("conv_id").alias("doc_id"), rows.alias("r")).select("doc_id", "r.*")
    root = t.where("k = 0").select(
        F.col("conv_id").alias("doc_id"), F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ordinal"),
        F.lit(0).alias("depth"), (6 * F.col("n")).alias("last_desc"), F.lit("document").alias("kind"),
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("level"),
    )
    return root.unionByName(body).withColumn(
        "props", F.when(F.col("kind") == "heading", F.concat(F.lit('{"level": '), F.col("level"), F.lit("}"))).otherwise(F.lit("{}"))
    )
