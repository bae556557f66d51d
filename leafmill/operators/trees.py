"""Paths, properties, notes and comparison of trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .stage import gathered


def with_paths(nodes: DataFrame) -> DataFrame:
    """Add ``place`` (child indexes, ``/0/2/1``; the root ``/``) and ``path`` (``/paragraph[1]/text[2]``).

    A step of ``path`` counts siblings of its own kind, so an inserted node
    moves only those of its kind behind it.  A task goes through its documents
    in pre-order and holds the paths of one document.
    """
    first = ["doc_id", "node_id"]
    ready = nodes.where("doc_id IS NOT NULL").select(*first, *[c for c in nodes.columns if c not in first])
    schema = StructType([*ready.schema.fields, StructField("place", StringType()), StructField("path", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = None
        at: dict[int, tuple[str, str]] = {}
        nth: dict[tuple, int] = {}
        for batch in batches:
            places, paths = [], []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "node_id", "parent_id", "ordinal", "kind")]
            for i, node, parent, ordinal, kind in zip(*columns, strict=True):
                if i != doc:
                    doc, at, nth = i, {}, {}
                above = at.get(parent)
                if above is None:
                    place = path = ""
                else:
                    n = nth[parent, kind] = nth.get((parent, kind), 0) + 1
                    place, path = f"{above[0]}/{ordinal}", f"{above[1]}/{kind}[{n}]"
                at[node] = place, path
                places.append(place or "/")
                paths.append(path or "/")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.string()), pa.array(paths, pa.string())], [f.name for f in schema])

    return gathered(ready, "node_id").mapInArrow(run, schema)


def at_place(nodes: DataFrame, place: str) -> DataFrame:
    """The node of each document at child indexes like ``/0/2/1``; ``/`` is the root.

    One equi-join by document a step, no paths are built.
    """
    found = nodes.where("node_id = 0")
    for step in [int(x) for x in place.split("/") if x]:
        above = found.select("doc_id", F.col("node_id").alias("parent_id"))
        found = nodes.where(F.col("ordinal") == step).join(above, ["doc_id", "parent_id"], "left_semi")
    return found


def get_prop(props: Column, name: str, kind: str) -> Column:
    """A property of one type, ``string``, ``long`` or ``boolean``; null when absent or of another type."""
    value = F.try_variant_get(F.try_parse_json(props), f'$["{name}"]', "variant")
    held = {"string": "STRING", "long": "BIGINT", "boolean": "BOOLEAN"}[kind]
    return F.when(F.schema_of_variant(value) == held, F.try_variant_get(value, "$", kind))


def has_prop(props: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(props), name), F.lit(False))


def _entries(props: Column) -> Column:
    return F.coalesce(F.from_json(props, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))


def remove_prop(props: Column, name: str) -> Column:
    return F.to_json(F.map_filter(_entries(props), lambda k, _: k != name))


def set_prop(props: Column, name: str, value: Column) -> Column:
    """``props`` with one property set; ``value`` is a string, a number or a boolean."""
    rest = F.map_filter(_entries(props), lambda k, _: k != name)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(name), value.cast("variant"))))


def update_nodes(nodes: DataFrame, where: Column, **columns: Column) -> DataFrame:
    """Rewrite columns of the nodes that ``where`` holds for; all others stay as they are."""
    hit = F.coalesce(where, F.lit(False))
    return nodes.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in columns.items()})


def map_documents(nodes: DataFrame, change: Callable) -> DataFrame:
    """``change`` (a tree to a tree) on every document, for what columns cannot say."""
    from ..model import NODES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..model import flatten, rebuild

        rows = flatten(int(pdf["doc_id"].iloc[0]), change(rebuild(pdf.to_dict("records"))))
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in NODES.split(", ")])
        return out.astype({"parent_id": "Int32", "level": "Int32"})

    return nodes.groupBy("doc_id").applyInPandas(run, NODES)


def node_texts(nodes: DataFrame) -> DataFrame:
    """``(doc_id, text)``: all content in document order; documents without any give the empty text."""
    held = F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("node_id", "content"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x["content"]), "").alias("text"))


def footnotes(nodes: DataFrame) -> DataFrame:
    """``(doc_id, label, ref_id, def_id)``: each reference with the first definition of its label.

    References without a definition have a null ``def_id``, definitions that
    nothing refers to a null ``ref_id``.  Notes without a label are not joined.
    """
    label = F.get_json_object("props", "$.label")
    of = lambda kind, name: nodes.where(F.col("kind") == kind).select("doc_id", label.alias("label"), F.col("node_id").alias(name)).where("label IS NOT NULL")
    defs = of("footnote_def", "def_id").groupBy("doc_id", "label").agg(F.min("def_id").alias("def_id"))
    return of("footnote_ref", "ref_id").join(defs, ["doc_id", "label"], "full").select("doc_id", "label", "ref_id", "def_id")


@dataclass(frozen=True)
class Ignore:
    """What ``compare_trees`` overlooks."""

    whitespace: bool = False
    order: bool = False
    attributes: tuple[str, ...] = ()
    elements: tuple[str, ...] = ()


STRICT = Ignore()
LENIENT = Ignore(whitespace=True, attributes=("xmlns",))
#: Namespaces and extension lists of office documents (fixed values).
OFFICE = Ignore(whitespace=True, attributes=("xmlns", "xmlns:r", "xmlns:mc", "mc:Ignorable"), elements=("extLst",))


def compare_trees(a: DataFrame, b: DataFrame, ignore: Ignore = STRICT) -> DataFrame:
    """``(doc_id, path, difference, attribute, before, after)`` of two ``nodes`` tables.

    Nodes are matched by ``path``.  Differences: ``missing_element``,
    ``extra_element``, ``text_changed``, ``order_changed`` (its rank among the
    matched siblings), ``attribute_changed``, ``missing_attribute`` and
    ``extra_attribute``.  Below an ignored element nothing is compared.
    """

    def side(nodes: DataFrame, n: str) -> DataFrame:
        paths = with_paths(nodes)
        if ignore.elements:
            paths = paths.where(~F.col("path").rlike("/(" + "|".join(ignore.elements) + r")\["))
        text = F.col("content")
        if ignore.whitespace:
            text = F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
        attributes = F.map_filter(
            F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>")),
            lambda k, _: ~k.isin("content", *ignore.attributes),
        )
        above = F.regexp_replace("path", r"/[^/]*$", "")
        return paths.select("doc_id", "path", F.struct("ordinal", text.alias("text"), attributes.alias("attributes")).alias(n), above.alias("_above"))

    both = side(a, "x").join(side(b, "y"), ["doc_id", "path", "_above"], "full")
    matched = F.col("x").isNotNull() & F.col("y").isNotNull()
    if ignore.order:
        moved = F.lit(False)
    else:
        among = Window.partitionBy("doc_id", "_above", matched)
        moved = matched & (F.row_number().over(among.orderBy("x.ordinal")) != F.row_number().over(among.orderBy("y.ordinal")))
    both = both.withColumn("_moved", moved)
    none = F.lit(None).cast("string")
    difference = lambda what, attribute=none, before=none, after=none: F.struct(
        F.lit(what).alias("difference"), attribute.alias("attribute"), before.alias("before"), after.alias("after")
    )
    whole = F.array(
        F.when(F.col("y").isNull(), difference("missing_element")),
        F.when(F.col("x").isNull(), difference("extra_element")),
        F.when(F.col("_moved"), difference("order_changed", none, F.col("x.ordinal").cast("string"), F.col("y.ordinal").cast("string"))),
        F.when(matched & ~F.col("x.text").eqNullSafe(F.col("y.text")), difference("text_changed", none, F.col("x.text"), F.col("y.text"))),
    )
    old, new = F.col("x.attributes"), F.col("y.attributes")
    of = F.transform(
        F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new))),
        lambda k: F.when(~F.map_contains_key(new, k), difference("missing_attribute", k, old[k]))
        .when(~F.map_contains_key(old, k), difference("extra_attribute", k, none, new[k]))
        .when(~old[k].eqNullSafe(new[k]), difference("attribute_changed", k, old[k], new[k])),
    )
    found = F.array_compact(F.concat(whole, F.when(matched, of).otherwise(F.array().cast("array<struct<difference:string,attribute:string,before:string,after:string>>"))))
    return both.select("doc_id", "path", F.explode(found).alias("d")).select("doc_id", "path", "d.*")
