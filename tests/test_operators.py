"""Transforms, the query language, scalars and registered queries."""

import pytest
from pyspark.sql import functions as F

from leafmill import model as m
from leafmill.functions import scalars as S
from leafmill.operators import corpus as C
from leafmill.operators import documents as D
from leafmill.operators import transforms as T
from leafmill.plans import jq, registry


def _nodes(spark, *trees):
    rows = [r for i, t in enumerate(trees) for r in m.flatten(i, t)]
    return spark.createDataFrame(rows, m.NODES)


def _trees(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["doc_id"], []).append(r.asDict())
    return {i: m.rebuild(rows) for i, rows in by.items()}


def _consistent(df):
    for i, tree in _trees(df).items():
        want = {(r[1], r[2], r[3], r[4], r[5]) for r in m.flatten(i, tree)}
        got = {(r.node_id, r.parent_id, r.ordinal, r.depth, r.last_desc) for r in df.where(f"doc_id = {i}").collect()}
        assert got == want


def test_strip_empty_leaves_what_it_empties(spark):
    tree = m.doc(m.para(" \u2003"), m.Node("paragraph"), m.Node("div"), m.para("x", ""), m.Node("div").add(m.Node("paragraph")))
    out = T.strip_empty(_nodes(spark, tree, m.doc()))
    assert _trees(out)[0] == m.doc(m.Node("paragraph"), m.para("x"), m.Node("div"))
    assert _trees(out)[1] == m.doc()
    _consistent(out)


def test_merge_text(spark):
    tree = m.doc(m.Node("paragraph").add(m.Node("text", {"content": "a", "k": 1}), m.Node("text", {"content": "b", "k": 2}), m.wrap("strong", "c", "d"), m.text("e")))
    out = T.merge_text(_nodes(spark, tree))
    assert [(r.kind, r.content) for r in out.orderBy("node_id").collect()] == [
        ("document", None), ("paragraph", None), ("text", "ab"), ("strong", None), ("text", "cd"), ("text", "e"),
    ]
    assert '"k": 1' in out.where("node_id = 2").first().props
    _consistent_ids = [(r.node_id, r.parent_id, r.ordinal, r.last_desc) for r in out.orderBy("node_id").collect()]
    assert _consistent_ids == [(0, None, 0, 5), (1, 0, 0, 5), (2, 1, 0, 2), (3, 1, 1, 4), (4, 3, 0, 4), (5, 1, 2, 5)]


def test_unwrap_chains(spark):
    inner = m.Node("div").add(m.Node("div").add(m.Node("span").add(m.para("x"))))
    tree = m.doc(m.para("first"), inner, m.Node("div", {"id": "k"}).add(m.para("kept")), m.Node("div").add(m.para("a"), m.Node("span").add(m.text("b"))))
    out = T.unwrap_single_child(_nodes(spark, tree))
    want = m.doc(m.para("first"), m.para("x"), m.Node("div", {"id": "k"}).add(m.para("kept")), m.Node("div").add(m.para("a"), m.text("b")))
    assert _trees(out)[0] == want
    _consistent(out)


def test_shift_headings(spark):
    tree = m.doc(m.heading(1, "a"), m.heading(6, "b"), m.Node("heading"), m.heading(3, "c"))
    out = T.shift_headings(_nodes(spark, tree), 2)
    assert [n.props.get("level") for n in _trees(out)[0].children] == [3, 6, None, 5]
    assert [r.level for r in T.shift_headings(_nodes(spark, tree), -9, 2, 4).where("kind = 'heading'").orderBy("node_id").collect()] == [2, 2, None, 2]


def test_failed_documents_are_rows(spark):
    df = spark.createDataFrame([(1, "<a><b></a>"), (2, "<article><para>x</para></article>"), (None, "x"), (3, None)], "id long, body string")
    got = {r.doc_id: (r.parse_ok, r.error_category) for r in D.docs(df, "docbook", "id", "body").collect()}
    assert got == {1: (False, "xml_malformed"), 2: (True, None), 3: (False, "xml_malformed")}
    assert {r.doc_id for r in D.nodes(df, "docbook", "id", "body").collect()} == {2}


@pytest.mark.parametrize(
    ("query", "value", "want"),
    [
        (".", 1, [1]), (".a.b", {"a": {"b": 2}}, [2]), (".a.b", {}, [None]), (".[]", [1, 2], [1, 2]), (".a?", [1], []), ("[.[] | . + 1]", [1, 2], [[2, 3]]),
        ("map(select(. > 1))", [1, 2, 3], [[2, 3]]), ("group_by(.k) | map({k: .[0].k, n: length})", [{"k": "b"}, {"k": "a"}, {"k": "b"}], [[{"k": "a", "n": 1}, {"k": "b", "n": 2}]]),
        (".a // \"d\"", {"a": False}, ["d"]), ("empty", 1, []), ("1, 2", None, [1, 2]), ("sort", [[], {}, "a", 1, None, True, False], [[None, False, True, 1, "a", [], {}]]),
        ("[..]", [1, [2]], [[[1, [2]], 1, [2], 2]]), ("reduce .[] as $x (0; . + $x)", [1, 2, 3], [6]), ("[foreach .[] as $x (0; . + $x)]", [1, 2, 3], [[1, 3, 6]]),
        ("if . > 1 then \"big\" elif . == 1 then \"one\" else \"small\" end", 1, ["one"]), ("try error(\"x\") catch .", 1, ["x"]), ("def f(g): [g, g]; f(.a)", {"a": 1}, [[1, 1]]),
        ("to_entries", {"a": 1}, [[{"key": "a", "value": 1}]]), ("with_entries(.value += 1)" if False else "with_entries({key: .key, value: (.value + 1)})", {"a": 1}, [{"a": 2}]), ("del(.a, .b[0])", {"a": 1, "b": [1, 2]}, [{"b": [2]}]),
        ("[paths]", {"a": [1]}, [[["a"], ["a", 0]]]), ("getpath([\"a\", \"b\"])", {"a": {"b": 3}}, [3]), ("setpath([\"a\", 0]; 1)", None, [{"a": [1]}]), ("limit(2; .[])", [1, 2, 3], [1, 2]), ("first(.[])", [5, 6], [5]),
        ("[range(3)]", None, [[0, 1, 2]]), ("join(\"-\")", ["a", 1, None], ["a-1-"]), ("test(\"^a\")", "abc", [True]), ("gsub(\"b\"; \"x\")", "abb", ["axx"]), ("unique_by(.k)", [{"k": 1, "v": 1}, {"k": 1, "v": 2}], [[{"k": 1, "v": 1}]]),
        ("\"n=\\(.a)\"", {"a": 1}, ["n=1"]), (".[1:]", [1, 2, 3], [[2, 3]]), (". as $x | [$x, $x]", 2, [[2, 2]]), ("any", [False, 1], [True]), ("flatten", [1, [2, [3]]], [[1, 2, 3]]), ("ascii_downcase", "AÉ", ["aÉ"]), ("tojson | fromjson", {"a": [1]}, [{"a": [1]}]),
        ("[.[] | tostring]", [1, "a", None], [["1", "a", "null"]]), ("min_by(.a)", [{"a": 2}, {"a": 1}], [{"a": 1}]), ("until(. > 100; . * 2)", 1, [128]), ("-1 + 2", None, [1]), ("{a, b: .c}", {"a": 1, "c": 2}, [{"a": 1, "b": 2}]), ("length", None, [0]),
    ],
)
def test_jq(query, value, want):
    assert jq.compile_query(query).apply(value) == want


def test_jq_errors():
    for bad in ("[", "nope", ".a | foo(1)", "if 1 then 2", "1 +"):
        with pytest.raises(jq.CompileError):
            jq.compile_query(bad)
    with pytest.raises(jq.RuntimeError_):
        jq.compile_query("1, (\"a\" + 1)").apply(None)


def test_jq_over_columns(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}}'), (2, "{}"), (3, None), (4, '{"a": 5}')], "id long, js string")
    assert [tuple(r) for r in jq.compile_query(".a.b").run(df, "id", "js").orderBy("id").collect()] == [(1, 0, "1"), (2, 0, "null")]
    out = jq.compile_query(".a | .b + 1").run(df, "id", "js").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, 0, "2"), (2, 0, "1")]  # a failing input gives nothing


def test_serials_and_references(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 59.0, 60.0, 61.0, 45000.99999999, 45000.25)], "s double")
    assert [r[0] for r in df.select(S.excel_date(F.col("s"))).collect()] == [None, "1900-01-01", "1900-02-28", "1900-02-29", "1900-03-01", "2023-03-15", "2023-03-15"]
    assert df.select(S.excel_datetime(F.col("s"))).collect()[5][0] == "2023-03-15 24:00:00"
    assert df.select(S.excel_datetime(F.col("s"))).collect()[6][0] == "2023-03-15 06:00:00"
    refs = spark.createDataFrame([("A1",), ("Z1",), ("AA1",), ("XFD1048576",)], "r string")
    assert [tuple(r) for r in refs.select(S.column_number(F.col("r")), S.row_number(F.col("r"))).collect()] == [(1, 1), (26, 1), (27, 1), (16384, 1048576)]
    assert [r[0] for r in refs.select(S.column_letter(S.column_number(F.col("r")))).collect()] == ["A", "Z", "AA", "XFD"]


def test_words_keep_what_has_two_bytes(spark):
    df = spark.createDataFrame([("é a ab1 B-c",), (None,)], "t string")
    assert [r[0] for r in df.select(C.words(F.col("t"))).collect()] == [["é", "ab", "bc"], []]


def test_edge_case_ladders(spark):
    df = spark.createDataFrame([(1, 999, 0), (2, 1000, 1), (3, 5000, 100)], "doc_id long, paragraphs long, tables long")
    got = {(r.doc_id, r.case_type, r.severity) for r in C.edge_cases(df).collect()}
    assert got == {(2, "many_paragraphs", "noteworthy"), (3, "many_paragraphs", "rare"), (3, "many_tables", "rare")}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) & {"strip_empty", "merge_text", "doc_word_counts", "corpus_upsert", "conv_toc", "word_coverage", "column_letter", "compare_trees", "node_properties", "data_uri", "parse_range", "fixture_criteria"}))
def test_registered_queries_match_their_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert key(tuple(r) for r in df.select(*cols).collect()) == key(want)
