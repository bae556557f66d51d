"""Cases that once gave wrong or no answers."""

import pytest
from pyspark.sql import functions as F

from leafmill.operators import corpus as C
from leafmill.operators import documents as D
from leafmill.plans.jq import RuntimeError_, compile_query


@pytest.mark.parametrize(
    ("query", "value", "want"),
    [
        (".k", {"k": "x"}, ["x"]),
        (".[1.5:2]", [1, 2, 3], [[2]]),
        (".[(0, 1):2]", [1, 2, 3], [[1, 2], [2]]),
        (".[empty:2]", [1, 2], []),
        ("[.[] | values]", [1, None, False], [[1, False]]),
        ("[.[] | strings, numbers]", [1, "a", None], [[1, "a"]]),
        ("[.[] | scalars]", [1, [2], {}], [[1]]),
        ("isempty(empty), isempty(1)", None, [True, False]),
        ("inside([1, 2, 3])", [1], [True]),
        ("transpose", [[1, 2], [3]], [[[1, 3], [2, None]]]),
        ('walk(if type == "number" then . + 1 else . end)', {"a": [1, {"b": 2}]}, [{"a": [2, {"b": 3}]}]),
        ("[limit(3; 1 | repeat(. * 2))]", None, [[1, 2, 4]]),
        ("abs, trunc", -1.5, [1.5, -1]),
        ("def values: 7; values", None, [7]),
    ],
)
def test_jq(query, value, want):
    assert compile_query(query).apply(value) == want


@pytest.mark.parametrize(
    ("query", "value"),
    [("to_entries", [1]), ("from_entries", [1]), ("implode", "x"), ("sqrt", -1), ("floor", float("inf")), ('test("(")', "x"), (".k", [1]), ("explode", None)],
)
def test_jq_type_errors_are_caught(query, value):
    with pytest.raises(RuntimeError_):
        compile_query(query).apply(value)
    assert compile_query(f"try ({query}) catch 0").apply(value) == [0]
    assert compile_query(f"[({query})?]").apply(value) == [[]]


def test_jq_tables(spark):
    rows = [(1, '{"k": "x"}'), (2, '{"k": "null"}'), (3, "{}"), (4, "[1]"), (5, "not json"), (6, None), (7, '{"k": [1, {"b": null}]}'), (8, "null")]
    df = spark.createDataFrame(rows, "id long, j string")
    for query in (".k", ".k | ."):
        got = {r.id: r.value for r in compile_query(query).run(df, "id", "j").collect()}
        assert got == {1: '"x"', 2: '"null"', 3: "null", 7: '[1, {"b": null}]', 8: "null"}
    assert compile_query("sqrt").run(df, "id", "j").count() == 0


def test_emit_writes_containers_and_metadata(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>The Name</title></head><body><h1>A</h1><p>one two</p></body></html>")], "page_id long, html string")
    nodes, docs = D.nodes(pages, "html", "page_id", "html"), D.docs(pages, "html", "page_id", "html")
    for fmt in ("docx", "odt", "epub", "pptx"):
        assert bytes(D.emit(nodes, fmt).first().output)[:2] == b"PK"
    back = D.nodes(D.emit(nodes, "docx"), "docx", "doc_id", "output")
    assert "one two" in " ".join(r.content or "" for r in back.collect())
    assert "The Name" in bytes(D.emit(nodes, "opml", docs).first().output).decode()


def test_word_coverage_keeps_empty_references(spark):
    ref = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "item_id long, text string")
    ours = spark.createDataFrame([("beta", 1)], "word string, n long")
    got = {r.item_id: (r.ref_words, r.found, r.coverage) for r in C.word_coverage(C.word_counts(ref, "item_id"), ours, "item_id", ref).collect()}
    assert got == {1: (3, 1, 0.333333), 2: (0, 0, 1.0), 3: (0, 0, 1.0)}


def test_interest_reason_order(spark):
    cols = "doc_id long, table_nesting int, paragraphs int, tables int, fonts int, images int"
    rows = [(1, 0, 1000, 1, 0, 1), (2, 2, 1000, 1, 0, 0), (3, 0, 1000, 0, 0, 0), (4, 4, 5000, 60, 0, 1), (5, 0, 2000, 60, 20, 1), (6, 0, 1, 1, 0, 0), (7, 1, 0, 0, 0, 3)]
    f = spark.createDataFrame(rows, cols)
    got = {r.doc_id: r.reason for r in C.interest_reason(C.edge_cases(f), f).collect()}
    assert got == {1: "tables_and_images", 2: "nested_tables", 3: "many_paragraphs", 4: "deep_table_nesting", 5: "many_paragraphs"}


def test_upsert_settles_ties_by_content(spark):
    cols = "path string, corpus string, parse_success boolean, error_category string, features_json string, at int"
    a, b = [spark.createDataFrame([("p", "c", True, None, x, 1)], cols) for x in ("{1}", "{2}")]
    assert C.upsert(a, b, "at").collect() == C.upsert(b, a, "at").collect()
    assert C.upsert(a, b.withColumn("at", F.lit(2)), "at").first().features_json == "{2}"


def test_page_titles_are_those_of_the_twin(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from leafmill.plans import registry

    pages = [
        "<title>token = &quot;x&quot;</title>", "<title>a&amp;&amp</title>", "<title> &amp;lt; &lt;b&gt; </title>", "<title>\tone\ntwo </title>",
        "<title>first</title><svg><title>second</title></svg>", '<meta property="og:title" content="other">', '<title lang="en">no</title>', "<TITLE>no</TITLE>",
        "<title></title>", "<title>open", "&lt;title>no&lt;/title>", "<title>caf\u00e9 $1 \\\\</title>", "", None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, title FROM ({registry.ORACLE_SQL['page_titles']}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in registry.QUERIES["page_titles"](spark, str(tmp_path)).orderBy("page_id").collect()] == want


def test_workers_hand_on_rows_before_they_have_read_all_documents():
    """Rows of a whole Arrow batch of documents (10,000) were held at once."""
    from leafmill.model import NODES

    read = []

    def parsed(n, size, count):
        for i in range(n):
            read.append(i)
            yield size, [(i, k, None, 0, 0, 0, "text", "x", None, "{}") for k in range(count)]

    batches = D.in_batches(parsed(10_000, 10, 70), NODES)
    assert next(batches).num_rows == D.ROWS and len(read) <= D.ROWS // 70 + 1
    assert D.ROWS + sum(b.num_rows for b in batches) == 700_000
    read.clear()
    assert next(D.in_batches(parsed(10_000, D.CHARS // 4, 70), NODES)).num_rows == 280 and len(read) == 4
    assert [b.num_rows for b in D.in_batches(parsed(1, 10, D.ROWS + 1), NODES)] == [D.ROWS, 1]
    assert list(D.in_batches(parsed(3, D.CHARS, 0), NODES)) == []


def test_nodes_of_many_pages(spark):
    pages = [(i, f"<h1>t{i}</h1><p>a<b>b</b>") for i in range(3_000)] + [(None, "<p>no"), (9_999, None)]
    got = D.nodes(spark.createDataFrame(pages, "id long, html string").coalesce(1), "html", "id", "html")
    assert got.count() == 7 * 3_000 + 1
    assert [tuple(r) for r in got.where("doc_id = 2999").select("node_id", "parent_id", "kind", "content", "level").orderBy("node_id").collect()] == [
        (0, None, "document", None, None), (1, 0, "heading", None, 1), (2, 1, "text", "t2999", None), (3, 0, "paragraph", None, None),
        (4, 3, "text", "a", None), (5, 3, "strong", None, None), (6, 5, "text", "b", None),
    ]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_written_where_they_are_read(spark, tmp_path):
    """Nodes of every page were shuffled and written in a pandas group each."""
    from leafmill.plans import registry

    pages = [(1, "<h1>Größe</h1><p>a <b>b</b><ul><li>x<li>y</ul>"), (2, ""), (3, "<table><tr><th>h<tr><td>c|d</table><pre>x\n y</pre>"), (4, None), (None, "<p>no")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["page_to_markdown"](spark, str(tmp_path))
    assert "Exchange" not in _plan(got) and "InPandas" not in _plan(got)
    one_pass = {r.doc_id: r.output for r in got.collect()}
    by_nodes = {r.doc_id: bytes(r.output).decode() for r in D.emit(D.nodes(df, "html", "page_id", "html"), "markdown").collect()}
    assert one_pass == by_nodes and set(one_pass) == {1, 2, 3, 4} and "# Größe" in one_pass[1]


def test_only_the_columns_asked_for_leave_the_parser(spark, tmp_path):
    from leafmill.plans import registry

    pages = [(1, "<h1 id=a>x</h1><h1>y<h2>z</h2><p>a <b>b</b><ul><li>x"), (2, ""), (3, "<p>no heading"), (None, "<h1>no")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    whole = D.nodes(df, "html", "page_id", "html")
    few = D.nodes(df, "html", "page_id", "html", ("level", "doc_id"))
    assert few.columns == ["level", "doc_id"] and sorted(map(repr, few.collect())) == sorted(map(repr, whole.select("level", "doc_id").collect()))
    run = {n: registry.QUERIES[n](spark, str(tmp_path)) for n in ("page_kind_census", "page_headings", "page_features")}
    assert not any("props" in _plan(df) for df in run.values())
    assert run["page_kind_census"].collect() == C.kind_census(whole).collect()
    assert [tuple(r) for r in run["page_headings"].collect()] == [(1, 2)]
    assert sorted(run["page_features"].collect()) == sorted(C.node_features(whole).collect())


def test_strip_and_merge_parses_in_bounded_batches(spark, tmp_path):
    from leafmill.plans import registry

    df = spark.createDataFrame([(1, "<div><p>a</p></div><p></p><div><span>x</span></div>"), (2, "<p>b<b>c</b>"), (3, None)], "page_id long, html string")
    plan = _plan(D.nodes(df, "html", "page_id", "html"))
    assert "MapInArrow" in plan and "InPandas" not in plan
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["page_strip_and_merge"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("document", 3), ("paragraph", 2), ("strong", 1), ("text", 4)]
