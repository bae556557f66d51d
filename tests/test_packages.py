"""Containers as tables, and corpus validation."""

from leafmill import model as m
from leafmill import sinks
from leafmill.operators import corpus as C
from leafmill.operators import packages as P


def test_tables_of_containers(spark):
    sheet = m.Node("sheet", {"title": "S"}).add(m.Node("sheet_row").add(m.Node("sheet_cell", {"value:type": "number", "value:data": "7"}), m.Node("sheet_cell"), m.Node("sheet_cell", {"value:type": "string", "value:data": "x"})))
    book = sinks.write("xlsx", m.Document(m.doc(sheet)))
    df = spark.createDataFrame([(1, bytearray(book)), (2, bytearray(b"no zip")), (3, None)], "doc_id long, content binary")
    assert {(r.sheet, r.row, r.col, r.value_type, r.value_data) for r in P.sheet_cells(df).collect()} == {("S", 1, 1, "number", "7"), ("S", 1, 3, "string", "x")}
    parts = {r.part: r.content_type for r in P.package_parts(df).collect()}
    assert "xl/workbook.xml" in parts and parts["xl/workbook.xml"].endswith("main+xml")
    rels = P.relationships(df)
    assert {(r.part, r.target) for r in rels.collect()} == {("", "xl/workbook.xml"), ("xl/workbook.xml", "xl/worksheets/sheet1.xml")}
    assert P.broken_relationships(rels, P.package_parts(df)).count() == 0
    assert P.broken_relationships(rels, P.package_parts(df).where("part <> 'xl/workbook.xml'")).count() == 1
    assert P.zip_entries(df).where("doc_id = 1").count() == 5


def test_validation(spark):
    fonts = spark.createDataFrame([("Arial",), ("arial",), ("Odd",)], "font string")
    known = spark.createDataFrame([("ARIAL",)], "font string")
    assert [r[0] for r in C.uncommon(fonts, known, "font").collect()] == ["Odd"]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    issues = spark.createDataFrame([(1, "warning"), (2, "warning"), (2, "error")], "doc_id long, severity string")
    assert tuple(C.validation_stats(issues, docs).first()) == (1, 1, 1)
