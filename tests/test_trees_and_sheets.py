"""Paths, notes, comparison of trees, sheet lookups, and the scalars beside them."""

from pyspark.sql import functions as F

from leafmill import model as m
from leafmill.functions import scalars as S
from leafmill.operators import corpus as C
from leafmill.operators import sheets as H
from leafmill.operators import trees as R


def _nodes(spark, *trees):
    return spark.createDataFrame([r for i, t in enumerate(trees) for r in m.flatten(i, t)], m.NODES)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_paths_and_places(spark):
    tree = m.doc(m.para("a", "b"), m.Node("div"), m.para("c"))
    nodes = _nodes(spark, tree, m.doc())
    got = {(r.doc_id, r.node_id): (r.place, r.path) for r in R.with_paths(nodes).collect()}
    assert got == {
        (0, 0): ("/", "/"), (0, 1): ("/0", "/paragraph[1]"), (0, 2): ("/0/0", "/paragraph[1]/text[1]"),
        (0, 3): ("/0/1", "/paragraph[1]/text[2]"), (0, 4): ("/1", "/div[1]"), (0, 5): ("/2", "/paragraph[2]"),
        (0, 6): ("/2/0", "/paragraph[2]/text[1]"), (1, 0): ("/", "/"),
    }
    assert [r.content for r in R.at_place(nodes, "/0/1").collect()] == ["b"]
    assert R.at_place(nodes, "/9").count() == 0 and R.at_place(nodes, "/").count() == 2


def test_compare_trees(spark):
    a = m.doc(m.Node("div", {"id": "x", "k": 1}), m.Node("table"), m.para("one  two"), m.Node("extLst").add(m.para("z")))
    b = m.doc(m.Node("table"), m.Node("div", {"id": "y", "xmlns": "u"}), m.para("one two"), m.para("new"))
    found = R.compare_trees(_nodes(spark, a), _nodes(spark, b))
    assert _rows(found.select("path", "difference", "attribute", "before", "after")) == sorted([
        ("/div[1]", "attribute_changed", "id", "x", "y"), ("/div[1]", "missing_attribute", "k", "1", None),
        ("/div[1]", "extra_attribute", "xmlns", None, "u"), ("/div[1]", "order_changed", None, "0", "1"), ("/table[1]", "order_changed", None, "1", "0"),
        ("/paragraph[1]/text[1]", "text_changed", None, "one  two", "one two"),
        ("/extLst[1]", "missing_element", None, None, None), ("/extLst[1]/paragraph[1]", "missing_element", None, None, None),
        ("/extLst[1]/paragraph[1]/text[1]", "missing_element", None, None, None),
        ("/paragraph[2]", "extra_element", None, None, None), ("/paragraph[2]/text[1]", "extra_element", None, None, None),
    ], key=repr)
    mild = R.compare_trees(_nodes(spark, a), _nodes(spark, b), R.Ignore(True, True, ("xmlns", "k", "id"), ("extLst",)))
    assert _rows(mild.select("path", "difference")) == [("/paragraph[2]", "extra_element"), ("/paragraph[2]/text[1]", "extra_element")]
    assert R.compare_trees(_nodes(spark, a), _nodes(spark, a)).count() == 0


def test_an_inserted_node_is_one_difference(spark):
    a, b = m.doc(m.para("a"), m.para("b")), m.doc(m.Node("horizontal_rule"), m.para("a"), m.para("b"))
    assert [tuple(r) for r in R.compare_trees(_nodes(spark, a), _nodes(spark, b)).select("path", "difference").collect()] == [("/horizontal_rule[1]", "extra_element")]


def test_properties(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "n": 3, "b": true, "l": [1]}'), (2, "{}"), (3, None), (4, "no json")], "i int, props string")
    p = F.col("props")
    got = df.select("i", *[R.get_prop(p, k, t).alias(f"{k}{t}") for k in "anbl" for t in ("string", "long", "boolean")]).where("i = 1").first()
    assert {k: v for k, v in got.asDict().items() if v is not None} == {"i": 1, "astring": "x", "nlong": 3, "bboolean": True}
    assert [tuple(r) for r in df.select(R.get_prop(p, "a", "string"), R.has_prop(p, "a")).orderBy("i").collect()] == [("x", True), (None, False), (None, False), (None, False)]
    changed = df.select(R.set_prop(R.remove_prop(p, "l"), "a", F.lit("y")).alias("props")).select("props", R.get_prop(F.col("props"), "a", "string").alias("a"), R.has_prop(F.col("props"), "l").alias("l"))
    assert [(r.a, r.l) for r in changed.collect()] == [("y", False)] * 4


def test_map_update_and_text(spark):
    nodes = _nodes(spark, m.doc(m.para("a", "b")), m.doc())
    loud = R.update_nodes(nodes, F.col("kind") == "text", content=F.upper("content"))
    assert _rows(R.node_texts(loud)) == [(0, "AB"), (1, "")]
    out = R.map_documents(nodes, lambda t: m.doc(*t.children, m.para("end")))
    assert _rows(R.node_texts(out)) == [(0, "abend"), (1, "end")]


def test_footnotes(spark):
    note = lambda kind, label: m.Node(kind, {} if label is None else {"label": label})
    tree = m.doc(note("footnote_ref", "1"), note("footnote_ref", "1"), note("footnote_ref", "x"), note("footnote_def", "1"), note("footnote_def", "1"), note("footnote_def", "2"), note("footnote_ref", None))
    assert _rows(R.footnotes(_nodes(spark, tree))) == sorted([(0, "1", 1, 4), (0, "1", 2, 4), (0, "x", 3, None), (0, "2", None, 6)], key=repr)


def test_ranges_cells_dates(spark):
    df = spark.createDataFrame([("A1:C3",), ("b12",), ("A1:",), ("1A",), ("A1:B2:C3",), (None,)], "r string").withColumn("p", S.parse_range(F.col("r")))
    got = [None if r.p is None else tuple(r.p) for r in df.collect()]
    assert got == [(1, 1, 3, 3), (12, 2, 12, 2), None, None, None, None]
    cells = spark.createDataFrame([("number", 2.5, None, None), ("number", 0.0, None, None), ("string", None, "1", None), ("string", None, " 1", None), ("string", None, "TRUE", None), ("string", None, "1d", None), ("boolean", None, None, True), ("error", 1.0, "1", None)], "k string, n double, s string, b boolean")
    k, n, s, b = (F.col(c) for c in "knsb")
    assert [tuple(r) for r in cells.select(S.as_number(k, n, s), S.as_bool(k, n, s, b)).collect()] == [(2.5, True), (0.0, False), (1.0, True), (None, None), (None, True), (None, None), (None, True), (None, None)]
    dates = spark.createDataFrame([("2020/05/07/late",), ("2020",), ("2020//03",), ("2020/13/01",), ("2020/2/40",), ("20/01",), ("",), (None,)], "d string")
    got = [None if r[0] is None else tuple(r[0]) for r in dates.select(S.partial_date(F.col("d"))).collect()]
    assert got == [(2020, 5, 7), (2020, None, None), (2020, None, None), (2020, None, None), (2020, 2, None), None, None, None]


def test_data_addresses(spark):
    uris = ["data:image/png;base64,QUJD", "data:;base64,QU\nJD", "data:,a%20b%C3%A9+", "data:text/html,%zz%4", "http://x", "data:;base64,*", None]
    got = [r[0] and (r[0].mime_type, bytes(r[0].data)) for r in spark.createDataFrame([(u,) for u in uris], "u string").select(S.data_uri(F.col("u"))).collect()]
    assert got == [("image/png", b"ABC"), ("", b"ABC"), ("text/plain;charset=US-ASCII", "a bé+".encode()), ("text/html", b""), None, None, None]


def test_sheet_lookups(spark):
    cells = spark.createDataFrame([("s", 1, 1), ("s", 70, 2), ("t", 1, 200)], "sheet string, row int, col int")
    rules = spark.createDataFrame([("a", 1, 1, 100, 2), ("b", 1, 100, 1, 300), ("c", 5, 5, 4, 4)], "rule string, r1 int, c1 int, r2 int, c2 int").where("r1 <= r2")
    assert _rows(H.rules_at(cells, rules).select("sheet", "rule")) == [("s", "a"), ("s", "a"), ("t", "b")]
    assert _rows(H.dimensions(cells, ["sheet"])) == [("s", 1, 70, 1, 2), ("t", 1, 1, 200, 200)]
    widths = spark.createDataFrame([(1, 1, 1), (2, 1, 3)], "id int, first int, last int")
    assert _rows(H.with_widths(cells, widths, "col").select("col", "width_id")) == [(1, 1), (2, 2), (200, None)]
    names = spark.createDataFrame([("Rate", None, "g"), ("rate", "s", "l")], "name string, sheet string, refers_to string")
    uses = spark.createDataFrame([("RATE", "s"), ("rate", "t"), ("none", "s")], "name string, sheet string")
    assert _rows(H.resolve_names(uses, names).select("name", "sheet", "refers_to")) == [("RATE", "s", "l"), ("none", "s", None), ("rate", "t", "g")]


def test_selection_of_documents(spark):
    f = spark.createDataFrame([(1, 10, 1), (2, 60, 0), (3, 10, 0)], "doc_id long, paragraphs long, tables long")
    cases = spark.createDataFrame([(1, "images", 0), (2, "many_tables", 2), (3, "many_fonts", 3), (3, "links", 0)], "doc_id long, case_type string, severity_rank int")
    ids = lambda **k: sorted(r.doc_id for r in C.matching(f, cases, **k).collect())
    assert ids() == [1, 2, 3] and ids(**C.preset("nothing such")) == [1, 2, 3]
    assert ids(**C.preset("interesting")) == [2, 3] and ids(**C.preset("minimal")) == [1, 3] and ids(**C.preset("tables")) == [1]
    assert ids(case_types=("links", "images"), min_severity="rare") == [3]


def test_documents_stay_whole_when_the_plan_adapts(spark):
    """Roots and other nodes of turn trees come from two branches, which the adaptive plan cuts into different partitions."""
    from leafmill.operators import documents as D
    from leafmill.operators import transforms as T

    n = 3_000
    turns = spark.range(4 * n).selectExpr("id div 4 AS conv_id", "id % 4 AS turn", "'user' AS role", "repeat('text ', 60) AS text")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(held, ("16", "false", "100k"), strict=True):
            spark.conf.set(k, v)
        nodes = D.turn_nodes(turns)
        paths = R.with_paths(nodes).groupBy("path").count().collect()
        assert len(paths) == 1 + 6 * 4 and {r["count"] for r in paths} == {n}
        got = R.compare_trees(nodes, T.merge_text(T.shift_headings(nodes, 1))).groupBy("difference").count().collect()
        assert {tuple(r) for r in got} == {("attribute_changed", 4 * n), ("text_changed", 4 * n), ("missing_element", 8 * n)}
        out = D.emit(nodes, "markdown")
        assert out.count() == n and out.selectExpr("count(DISTINCT output)").first()[0] == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_paths_take_one_walk_without_a_group_for_each_document(spark):
    plan = R.with_paths(_nodes(spark, m.doc(m.para("a"))))._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    # Nodes whose parent is not in the table begin anew; those of no document have no path.
    rows = [(1, 4, 9, 0, 2, 4, "text", "x", None, "{}"), (1, 5, 4, 3, 3, 5, "text", "y", None, "{}"), (None, 0, None, 0, 0, 0, "document", None, None, "{}")]
    assert _rows(R.with_paths(spark.createDataFrame(rows, m.NODES)).select("node_id", "place", "path")) == [(4, "/", "/"), (5, "/3", "/text[1]")]
