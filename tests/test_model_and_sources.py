"""The document model, sources and sinks."""

import io
import json
import zipfile

import pytest

from leafmill import model as m
from leafmill import sinks
from leafmill.sources import containers, data
from leafmill.sources.registry import categorize, detect, parse, readers


def kinds(d):
    return [n.kind for n in d.root.walk()]


def test_flatten_and_rebuild():
    d = m.doc(m.heading(2, "T"), m.para("a ", m.wrap("strong", "b")), m.bullet_list(m.list_item(m.para("x")), m.list_item(m.para("y"))))
    rows = m.flatten(7, d)
    names = [c.split(" ")[0] for c in m.NODES.split(", ")]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    assert [r["node_id"] for r in dicts] == list(range(len(dicts)))
    for r in dicts:
        inside = [x for x in dicts if r["node_id"] < x["node_id"] <= r["last_desc"]]
        assert all(x["depth"] > r["depth"] for x in inside)
        assert len([x for x in dicts if x["parent_id"] == r["node_id"]]) == len({x["ordinal"] for x in inside if x["parent_id"] == r["node_id"]})
    assert m.rebuild(reversed(dicts)) == d


def test_deep_trees_do_not_recurse():
    d = m.Node("document")
    n = d
    for _ in range(5000):
        n.add(m.Node("div"))
        n = n.children[0]
    assert len(m.flatten(1, d)) == 5001
    assert m.flatten(1, d)[0][5] == 5000


def test_special_floats_in_json():
    d = m.Document(m.Node("document", {"a": float("nan"), "b": [float("inf")]}))
    assert d.to_json()["content"]["props"] == {"a": "NaN", "b": ["Infinity"]}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b", ["document", "paragraph", "text", "paragraph", "text"]),
        ("<ul><li>x<li>y</ul>", ["document", "list", "list_item", "text", "list_item", "text"]),
        ("<b>bold<br><p>in</p>out", ["document", "strong", "text", "line_break", "paragraph", "text", "text"]),
        ("<script>var t='</p>'</script><p>x", ["document", "paragraph", "text"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["document", "table", "table_row", "table_cell", "text", "table_cell", "text", "table_row", "table_header", "text"]),
        ("", ["document"]),
        ("   \n ", ["document"]),
    ],
)
def test_html_recovery(page, want):
    assert kinds(parse("html", page)) == want


def test_html_metadata_and_unknown_tags():
    d = parse("html", '<html lang="de"><head><title>A &amp; B</title><meta charset="utf-8"><meta property="og:kind" content="k"></head><blink>x</blink>')
    assert d.metadata == {"language": "de", "title": "A & B", "charset": "utf-8", "kind": "k"}
    assert [(w.severity, w.detail) for w in d.warnings] == [("minor", "blink")]


def test_csv_rules():
    d = data.csv('Name,Note\n\nAl,"x, ""y"""\nragged\n')
    rows = [[c.text() for c in r.children] for r in d.root.children[0].children]
    assert rows == [["Name", "Note"], ["Al", 'x, "y"'], ["ragged"]]
    assert [c.kind for c in d.root.children[0].children[0].children] == ["table_header"] * 2
    assert sinks.write("csv", d) == 'Name,Note\nAl,"x, ""y"""\nragged\n'
    assert data.tsv(" a \tb").root.children[0].children[0].children[0].text() == " a "
    assert sinks.write("csv", m.Document(m.doc())) == ""


@pytest.mark.parametrize("fmt", ["markdown", "commonmark", "gfm", "djot", "org", "rst", "asciidoc", "textile", "mediawiki", "dokuwiki", "jira", "typst", "html", "docbook", "jats", "tei", "latex"])
def test_round_trip(fmt):
    tree = m.doc(m.heading(1, "Title"), m.para("plain ", m.wrap("strong", "bold"), " end"), m.bullet_list(m.list_item(m.para("one")), m.list_item(m.para("two"))))
    out = sinks.write(fmt, m.Document(tree, {"title": "Title"}))
    back = parse(fmt, out)
    found = kinds(back)
    assert {"heading", "strong", "list"} <= set(found), out
    assert found.count("list_item") == 2
    for word in ("Title", "bold", "one", "two"):
        assert word in back.root.text()


@pytest.mark.parametrize("fmt", ["docx", "odt", "epub", "pptx", "xlsx"])
def test_container_round_trip(fmt):
    tree = m.doc(m.heading(1, "Title"), m.para("plain ", m.wrap("emphasis", "it")), m.table(["h", "k"], ["1", "two"]))
    raw = sinks.write(fmt, m.Document(tree))
    assert raw == sinks.write(fmt, m.Document(tree))
    back = parse(fmt, raw)
    assert ("two" if fmt == "xlsx" else "Title") in back.root.text()
    if fmt in ("docx", "odt", "epub"):
        assert {"heading", "emphasis", "table_row"} <= set(kinds(back))
    assert containers.entries(raw)


def test_xlsx_values():
    raw = sinks.write("xlsx", m.Document(m.doc(m.Node("sheet", {"title": "S"}).add(m.Node("sheet_row").add(m.Node("sheet_cell", {"value:type": "number", "value:data": "45000"}), m.Node("sheet_cell"), m.Node("sheet_cell", {"value:type": "boolean", "value:data": "TRUE"}))))))
    row = parse("xlsx", raw).root.children[0].children[0]
    assert [c.props.get("value:data") for c in row.children] == ["45000", None, "TRUE"]
    assert containers.column_of("XFD1048576") == 16384 and containers.column_of("AA1") == 27
    assert [containers.format_kind(c) for c in ('"Days"0', "[Red]0", "[$-409]0", "[h]:mm", "m/d/yy h:mm", "0%", "mm")] == ["number", "number", "currency", "time", "date", "percentage", "number"]


def test_bibliographies():
    d = parse("bibtex", "@string{j = {Journal}}\n@article{k1, author = {Ann Lee and Bo Ray}, title = \"A {T}itle\", journal = j, pages = {12--15}, year = 2001}")
    fields = [(f.props["field:role"], f.props["content"]) for f in d.root.walk() if f.kind == "bibliography_field"]
    assert ("author", "Ann Lee") in fields and ("author", "Bo Ray") in fields and ("container_title", "Journal") in fields
    assert ("title", "A Title") in fields and ("page_first", "12") in fields and ("page_last", "15") in fields
    again = parse("ris", sinks.write("ris", d))
    assert [n.props["content"] for n in again.root.walk() if n.props.get("field:role") == "author"] == ["Ann Lee", "Bo Ray"]
    assert kinds(parse("bibtex", "no entries")) == ["document"]
    assert data.page_range("7") == ("7", None) and data.page_range("e7") == (None, None) and data.page_range("1 – 2") == ("1", "2")


def test_notebooks_and_pandoc():
    nb = {"cells": [{"cell_type": "markdown", "source": "# Hi"}, {"cell_type": "code", "source": "1", "outputs": [{"text": "\x1b[31m2\x1b[0m"}]}, {"cell_type": "odd"}], "metadata": {"kernelspec": {"language": "r"}}}
    d = parse("ipynb", json.dumps(nb))
    assert kinds(d) == ["document", "heading", "text", "code_block", "div", "code_block"]
    assert d.root.children[1].props["language"] == "r" and d.root.children[2].text() == "2" and len(d.warnings) == 1
    tree = m.doc(m.heading(1, "A b"), m.ordered_list(m.list_item(m.para("x")), start=3), m.table(["h"], ["c"]))
    assert parse("pandoc-json", sinks.write("pandoc-json", m.Document(tree))).root == tree
    assert parse("native", sinks.write("native", m.Document(tree))).root == tree


def test_front_matter_and_normalisation():
    d = parse("markdown", "---\ntitle: T\nnested:\n  k: 1\nnone: null\nempty: []\n---\n# H\r\nx\0y")
    assert d.metadata == {"title": "T", "nested.k": 1}
    assert d.root.children[1].text() == "x\ufffdy"


def test_errors_have_categories():
    for fmt, source, want in (("docx", b"no zip", "zip_corruption"), ("docbook", "<a><b></a>", "xml_malformed"), ("html", b"\xff\xfe\xfa", "xml_encoding"), ("nope", "", "unsupported_feature")):
        with pytest.raises(Exception) as e:
            parse(fmt, source)
        assert categorize(e.value) == want
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(Exception) as e:
        parse("odt", out.getvalue())
    assert categorize(e.value) == "missing_required_part"


def test_every_reader_takes_nothing():
    for fmt in readers():
        if fmt not in ("docx", "xlsx", "pptx", "odt", "epub", "ipynb", "pandoc-json", "native", "docbook", "jats", "tei", "fb2", "opml", "endnotexml"):
            assert parse(fmt, None).root.kind == "document"
    assert detect("a/b.MD") == "markdown" and detect("x") is None
    assert len(sinks.formats()) >= 60


def test_slides_and_chunks():
    tree = m.doc(m.para("lead"), m.heading(1, "One"), m.para("a"), m.heading(2, "Two"), m.para("b"), m.heading(1, "Three"))
    assert sinks.write("revealjs", m.Document(tree)).count("<section>") == 3
    assert "lead" not in sinks.write("slidy", m.Document(tree))
    assert "lead" in sinks.write("slideous", m.Document(tree))
    assert sinks.write("beamer", m.Document(tree)).count("\\begin{frame}") == 3
    from leafmill.sinks.slides import chunks

    made = chunks(m.Document(tree))
    assert [n for n, _, _ in made] == ["index.html", "chunk001.html", "chunk002.html", "chunk003.html"]
    assert [t for _, t, _ in made][1:] == ["", "One", "Three"]
