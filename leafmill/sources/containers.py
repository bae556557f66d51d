"""Zip containers: office packages, open documents and books; and a text-only PDF reader."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib

from ..model import Document, Node, text
from .xmlmap import _local, load


def entries(data: bytes) -> list[tuple[str, int, int, bool]]:
    """``(name, size, compressed size, encrypted)`` of each file in a zip."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, i.file_size, i.compress_size, bool(i.flag_bits & 1)) for i in z.infolist()]


class Package:
    """An office package: parts, content types and relationships."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def part(self, name: str) -> ET.Element:
        return load(self.zip.read(name))

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to ``(type, target)``; targets are resolved against the part."""
        folder, base = posixpath.split(part)
        path = posixpath.join(folder, "_rels", base + ".rels")
        if path not in self.names:
            return {}
        out = {}
        for r in self.part(path):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join("/" + folder, target)).lstrip("/")
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out

    def content_type(self, part: str) -> str | None:
        types = self.part("[Content_Types].xml")
        for t in types:
            if _local(t.tag) == "Override" and t.get("PartName", "").lstrip("/") == part:
                return t.get("ContentType")
        ext = part.rsplit(".", 1)[-1].lower()
        return next((t.get("ContentType") for t in types if _local(t.tag) == "Default" and t.get("Extension", "").lower() == ext), None)

    def main(self) -> str:
        return next((t for k, t in self.rels("").values() if k == "officeDocument"), "")


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _find(e: ET.Element, name: str):
    return [c for c in e if _local(c.tag) == name]


def _core(p: Package, d: Document) -> None:
    if "docProps/core.xml" in p.names:
        for e in p.part("docProps/core.xml"):
            key = {"creator": "author"}.get(_local(e.tag), _local(e.tag))
            if (e.text or "").strip():
                d.metadata[key] = e.text.strip()


# -- word processing ------------------------------------------------------------

_RUN = {"b": "strong", "i": "emphasis", "u": "underline", "strike": "strikeout", "smallCaps": "small_caps", "caps": "all_caps", "vanish": "hidden"}


def docx(data: bytes) -> Document:
    p, d = Package(data), Document(Node("document"))
    main = p.main() or "word/document.xml"
    rels = p.rels(main)
    _core(p, d)
    numbered = _numbering(p)
    body = next(e for e in p.part(main).iter() if _local(e.tag) == "body")
    d.root.add(*_word_blocks(body, rels, numbered))
    return d


def _numbering(p: Package) -> dict[str, bool]:
    """Whether a numbering id is ordered."""
    if "word/numbering.xml" not in p.names:
        return {}
    root, kinds, out = p.part("word/numbering.xml"), {}, {}
    for a in root:
        if _local(a.tag) == "abstractNum":
            fmt = next((_attr(x, "val") for x in a.iter() if _local(x.tag) == "numFmt"), "bullet")
            kinds[_attr(a, "abstractNumId")] = fmt != "bullet"
        elif _local(a.tag) == "num":
            ref = next((_attr(x, "val") for x in a if _local(x.tag) == "abstractNumId"), None)
            out[_attr(a, "numId")] = kinds.get(ref, False)
    return out


def _word_blocks(body: ET.Element, rels: dict, numbered: dict) -> list[Node]:
    out: list[Node] = []
    for e in body:
        tag = _local(e.tag)
        if tag == "sdt":
            for c in _find(e, "sdtContent"):
                out += _word_blocks(c, rels, numbered)
        elif tag == "tbl":
            t = Node("table")
            for tr in _find(e, "tr"):
                row = Node("table_row")
                for tc in _find(tr, "tc"):
                    cell = Node("table_cell")
                    span = next((_attr(x, "val") for x in tc.iter() if _local(x.tag) == "gridSpan"), None)
                    if span and span.isdigit():
                        cell.props["colspan"] = int(span)
                    row.add(cell.add(*_word_blocks(tc, rels, numbered)))
                t.add(row)
            out.append(t)
        elif tag == "p":
            style, level, num = "", None, None
            for pr in _find(e, "pPr"):
                for x in pr:
                    if _local(x.tag) == "pStyle":
                        style = _attr(x, "val") or ""
                    elif _local(x.tag) == "outlineLvl":
                        level = int(_attr(x, "val") or 0) + 1
                    elif _local(x.tag) == "numPr":
                        num = next((_attr(y, "val") for y in x if _local(y.tag) == "numId"), None)
            inner = _word_inlines(e, rels)
            m = re.match(r"(?i)heading\s*(\d)", style)
            if m or style.lower() == "title":
                level = int(m[1]) if m else 1
            if level and 1 <= level <= 9:
                out.append(Node("heading", {"level": min(6, level)}).add(*inner))
            elif num and num != "0":
                ordered = numbered.get(num, False)
                if not (out and out[-1].kind == "list" and out[-1].props["ordered"] == ordered):
                    out.append(Node("list", {"ordered": ordered}))
                out[-1].add(Node("list_item").add(Node("paragraph").add(*inner)))
            elif style.lower() in ("quote", "intensequote", "blocktext"):
                out.append(Node("blockquote").add(Node("paragraph").add(*inner)))
            elif "code" in style.lower() or style.lower() == "htmlpreformatted":
                out.append(Node("code_block", {"content": "".join(n.text() for n in inner)}))
            elif inner:
                out.append(Node("paragraph").add(*inner))
    return out


def _word_inlines(e: ET.Element, rels: dict) -> list[Node]:
    out: list[Node] = []
    for r in e:
        tag = _local(r.tag)
        if tag == "hyperlink":
            url = rels.get(_attr(r, "id") or "", ("", ""))[1] or "#" + (_attr(r, "anchor") or "")
            out.append(Node("link", {"url": url}).add(*_word_inlines(r, rels)))
        elif tag in ("ins", "smartTag", "sdtContent", "fldSimple"):
            out += _word_inlines(r, rels)
        elif tag == "r":
            on = []
            for pr in _find(r, "rPr"):
                for x in pr:
                    name, val = _local(x.tag), _attr(x, "val")
                    if name in _RUN and val not in ("0", "false", "none"):
                        on.append(_RUN[name])
                    elif name == "vertAlign" and val in ("superscript", "subscript"):
                        on.append(val)
            nodes: list[Node] = []
            for x in r:
                name = _local(x.tag)
                if name == "t":
                    nodes.append(text(x.text or ""))
                elif name == "tab":
                    nodes.append(text("\t"))
                elif name == "br":
                    nodes.append(Node("line_break"))
                elif name == "footnoteReference":
                    nodes.append(Node("footnote_ref", {"label": _attr(x, "id") or ""}))
                elif name == "drawing":
                    blip = next((_attr(y, "embed") for y in x.iter() if _local(y.tag) == "blip"), None)
                    alt = next((_attr(y, "descr") for y in x.iter() if _local(y.tag) == "docPr"), None)
                    nodes.append(Node("image", {"url": rels.get(blip or "", ("", ""))[1]} | ({"alt": alt} if alt else {})))
            for kind in reversed(on):
                nodes = [Node(kind).add(*nodes)] if nodes else nodes
            for n in nodes:
                if n.kind == "text" and out and out[-1].kind == "text":
                    out[-1].props["content"] += n.props["content"]
                else:
                    out.append(n)
    return [n for n in out if n.kind != "text" or n.props["content"]]


# -- spreadsheets -----------------------------------------------------------------


def column_of(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def number_text(n: float) -> str:
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)


def xlsx(data: bytes) -> Document:
    """A sheet node per sheet: the dense rectangle of its cells, with types; dates stay serial numbers."""
    p, d = Package(data), Document(Node("document"))
    main = p.main() or "xl/workbook.xml"
    rels = p.rels(main)
    _core(p, d)
    strings = []
    if "xl/sharedStrings.xml" in p.names:
        strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _find(p.part("xl/sharedStrings.xml"), "si")]
    kinds = _cell_kinds(p)
    for s in (x for x in p.part(main).iter() if _local(x.tag) == "sheet"):
        target = rels.get(_attr(s, "id") or "", ("", ""))[1]
        sheet = Node("sheet", {"title": _attr(s, "name") or ""})
        d.root.add(sheet)
        if target not in p.names:
            continue
        root, cells = p.part(target), {}
        for c in (x for x in root.iter() if _local(x.tag) == "c"):
            ref = _attr(c, "r") or ""
            digits = re.sub(r"\D", "", ref)
            if digits:
                cells[int(digits), column_of(ref)] = _cell(c, strings, kinds)
        spans = {}
        for m in (x for x in root.iter() if _local(x.tag) == "mergeCell"):
            a, _, b = (_attr(m, "ref") or "").partition(":")
            if b:
                ra, rb = (int(re.sub(r"\D", "", x)) for x in (a, b))
                spans[ra, column_of(a)] = (rb - ra + 1, column_of(b) - column_of(a) + 1)
        if cells:
            rows, cols = [r for r, _ in cells], [c for _, c in cells]
            for r in range(min(rows), max(rows) + 1):
                row = Node("sheet_row")
                for c in range(min(cols), max(cols) + 1):
                    props = dict(cells.get((r, c), {}))
                    if (r, c) in spans:
                        for k, v in zip(("rowspan", "colspan"), spans[r, c], strict=True):
                            if v > 1:
                                props[k] = v
                    shown = props.get("value:data")
                    row.add(Node("sheet_cell", props).add(*([text(shown)] if shown else [])))
                sheet.add(row)
    return d


def _cell_kinds(p: Package) -> list[str]:
    """What each cell style shows: date, time, currency, percentage or number."""
    if "xl/styles.xml" not in p.names:
        return []
    root, codes = p.part("xl/styles.xml"), {}
    for f in (x for x in root.iter() if _local(x.tag) == "numFmt"):
        codes[_attr(f, "numFmtId")] = _attr(f, "formatCode") or ""
    xfs = next((x for x in root if _local(x.tag) == "cellXfs"), [])
    return [format_kind(codes.get(i, BUILTIN.get(int(i or 0), "General"))) for i in (_attr(x, "numFmtId") for x in xfs)]


BUILTIN = {9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}


def format_kind(code: str) -> str:
    first = code.lower().split(";")[0]
    bare = re.sub(r'"[^"]*"?', "", re.sub(r"\\.", "", first))
    elapsed = re.search(r"\[(h+|m+|s+)\]", bare)
    money = "[$" in bare or re.search(r'"[^"]*[$€£¥][^"]*"', first)
    body = re.sub(r"\[[^\]]*\]?", "", bare)
    if re.search("[yd]", body):
        return "date"
    if re.search("[hs]", body) or elapsed:
        return "time"
    if money or re.search("[$€£¥]", body):
        return "currency"
    return "percentage" if "%" in body else "number"


def _cell(c: ET.Element, strings: list[str], kinds: list[str]) -> dict:
    kind, value = _attr(c, "t") or "n", next((v.text or "" for v in _find(c, "v")), None)
    formula = next((f.text or "" for f in _find(c, "f")), None)
    props: dict = {}
    if kind == "inlineStr":
        props = {"value:type": "string", "value:data": "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")}
    elif value is not None and kind == "s":
        i = int(value) if value.isdigit() else -1
        props = {"value:type": "string", "value:data": strings[i] if 0 <= i < len(strings) else f"#REF! {value}"}
    elif value is not None and kind == "b":
        props = {"value:type": "boolean", "value:data": "TRUE" if value == "1" else "FALSE"}
    elif value is not None and kind in ("str", "e"):
        props = {"value:type": "string", "value:data": value}
    elif value is not None:
        style = int(_attr(c, "s") or 0)
        try:
            props = {"value:type": kinds[style] if style < len(kinds) else "number", "value:data": number_text(float(value))}
        except (ValueError, OverflowError):
            props = {"value:type": "string", "value:data": value}
    if formula is not None:
        props |= {"value:formula": formula, "value:type": "formula-result"}
    return props


# -- presentations, open documents, books -------------------------------------------


def pptx(data: bytes) -> Document:
    p, d = Package(data), Document(Node("document"))
    main = p.main() or "ppt/presentation.xml"
    rels = p.rels(main)
    _core(p, d)
    for s in (x for x in p.part(main).iter() if _local(x.tag) == "sldId"):
        target = rels.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), ("", ""))[1]
        if target not in p.names:
            continue
        own, slide = p.rels(target), Node("div", {"classes": "slide"})
        for sp in p.part(target).iter():
            tag = _local(sp.tag)
            if tag == "sp":
                kind = next((_attr(x, "type") or "" for x in sp.iter() if _local(x.tag) == "ph"), "")
                for para in (x for x in sp.iter() if _local(x.tag) == "p"):
                    inner = []
                    for r in (x for x in para.iter() if _local(x.tag) in ("r", "br")):
                        if _local(r.tag) == "br":
                            inner.append(Node("line_break"))
                            continue
                        t = text("".join(x.text or "" for x in r if _local(x.tag) == "t"))
                        pr = next((x for x in r if _local(x.tag) == "rPr"), None)
                        for key, k in (("i", "emphasis"), ("b", "strong")):
                            if pr is not None and pr.get(key) == "1":
                                t = Node(k).add(t)
                        inner.append(t)
                    if inner:
                        slide.add(Node("heading", {"level": 1 if kind in ("title", "ctrTitle") else 2}).add(*inner) if kind in ("title", "ctrTitle", "subTitle") else Node("paragraph").add(*inner))
            elif tag == "tbl":
                slide.add(Node("table").add(*[Node("table_row").add(*[Node("table_cell").add(text("".join(t.text or "" for t in tc.iter() if _local(t.tag) == "t"))) for tc in _find(tr, "tc")]) for tr in _find(sp, "tr")]))
            elif tag == "pic":
                blip = next((_attr(y, "embed") for y in sp.iter() if _local(y.tag) == "blip"), None)
                slide.add(Node("image", {"url": own.get(blip or "", ("", ""))[1]}))
        d.root.add(slide)
    return d


def odt(data: bytes) -> Document:
    d = Document(Node("document"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = load(z.read("content.xml"))
        if "meta.xml" in z.namelist():
            for e in load(z.read("meta.xml")).iter():
                key = {"creator": "author", "title": "title", "language": "language", "date": "date"}.get(_local(e.tag))
                if key and (e.text or "").strip():
                    d.metadata[key] = e.text.strip()
    styles = {}
    for s in (x for x in root.iter() if _local(x.tag) == "style"):
        pr = next((x for x in s if _local(x.tag) == "text-properties"), None)
        if pr is not None:
            get = lambda n: _attr(pr, n) or ""  # noqa: E731, B023
            styles[_attr(s, "name")] = [k for k, on in (("strong", get("font-weight") == "bold"), ("emphasis", get("font-style") == "italic"), ("underline", get("text-underline-style") not in ("", "none")), ("strikeout", get("text-line-through-style") not in ("", "none")), ("superscript", get("text-position").startswith("super")), ("subscript", get("text-position").startswith("sub"))) if on]
    body = next((x for x in root.iter() if _local(x.tag) in ("text", "spreadsheet", "presentation") and "office" in x.tag), root)
    d.root.add(*_odf_blocks(body, styles))
    return d


def _odf_blocks(e: ET.Element, styles: dict) -> list[Node]:
    out = []
    for c in e:
        tag = _local(c.tag)
        if tag == "h":
            out.append(Node("heading", {"level": min(6, int(_attr(c, "outline-level") or 1))}).add(*_odf_inlines(c, styles)))
        elif tag == "p":
            inner = _odf_inlines(c, styles)
            if inner:
                out.append(Node("paragraph").add(*inner))
        elif tag == "list":
            out.append(Node("list", {"ordered": False}).add(*[Node("list_item").add(*_odf_blocks(i, styles)) for i in _find(c, "list-item")]))
        elif tag == "table":
            t = Node("table")
            for row in (x for x in c.iter() if _local(x.tag) == "table-row"):
                t.add(Node("table_row").add(*[Node("table_cell").add(*_odf_blocks(x, styles)) for x in _find(row, "table-cell")]))
            out.append(t)
        elif tag in ("section", "text-box", "frame", "page"):
            out += _odf_blocks(c, styles)
    return out


def _odf_inlines(e: ET.Element, styles: dict) -> list[Node]:
    out: list[Node] = []

    def put(s: str | None) -> None:
        if s:
            if out and out[-1].kind == "text":
                out[-1].props["content"] += s
            else:
                out.append(text(s))

    put(e.text)
    for c in e:
        tag = _local(c.tag)
        if tag == "span":
            nodes = _odf_inlines(c, styles)
            for k in reversed(styles.get(_attr(c, "style-name"), [])):
                nodes = [Node(k).add(*nodes)]
            out += nodes
        elif tag == "a":
            out.append(Node("link", {"url": _attr(c, "href") or ""}).add(*_odf_inlines(c, styles)))
        elif tag == "line-break":
            out.append(Node("line_break"))
        elif tag in ("tab", "s"):
            put("\t" if tag == "tab" else " " * int(_attr(c, "c") or 1))
        elif tag == "note":
            out.append(Node("footnote_def").add(*[n for b in _find(c, "note-body") for n in _odf_blocks(b, styles)]))
        elif tag == "frame":
            out += [Node("image", {"url": _attr(x, "href") or ""}) for x in c if _local(x.tag) == "image"]
        else:
            out += _odf_inlines(c, styles)
        put(c.tail)
    return out


def epub(data: bytes) -> Document:
    from . import html

    d = Document(Node("document"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opf = next(_attr(x, "full-path") for x in load(z.read("META-INF/container.xml")).iter() if _local(x.tag) == "rootfile")
        root, folder = load(z.read(opf)), posixpath.dirname(opf)
        for e in (x for x in root.iter() if _local(x.tag) == "metadata"):
            for m in e:
                key = {"creator": "author"}.get(_local(m.tag), _local(m.tag))
                if key != "meta" and (m.text or "").strip():
                    d.metadata.setdefault(key, m.text.strip())
        items = {_attr(x, "id"): _attr(x, "href") for x in root.iter() if _local(x.tag) == "item"}
        for ref in (x for x in root.iter() if _local(x.tag) == "itemref"):
            name = posixpath.normpath(posixpath.join(folder, items.get(_attr(ref, "idref")) or ""))
            if name in z.namelist():
                d.root.add(*html.parse(z.read(name).decode("utf-8", "replace")).root.children)
    return d


def pdf(data: bytes) -> Document:
    """Text of simple PDF files; larger fonts than the most frequent one make headings."""
    runs: list[tuple[float, str]] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        size = 0.0
        for t in re.finditer(rb"/\w+\s+([\d.]+)\s+Tf|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", body, re.S):
            if t[1]:
                size = float(t[1])
            else:
                parts = [t[2]] if t[2] is not None else re.findall(rb"\(((?:[^()\\]|\\.)*)\)", t[3])
                s = b"".join(re.sub(rb"\\([()\\])", rb"\1", x) for x in parts).decode("latin-1")
                if s.strip():
                    runs.append((size, re.sub(r"\s+", " ", s)))
    counts: dict[float, int] = {}
    for size, _ in runs:
        counts[round(size * 2)] = counts.get(round(size * 2), 0) + 1
    mode = min(counts, key=lambda k: (-counts[k], k)) / 2 if counts else 0.0
    d = Document(Node("document"))
    for size, s in runs:
        ratio = size / mode if mode else 1.0
        if ratio > 1.05:
            d.root.add(Node("heading", {"level": 1 if ratio >= 1.8 else 2 if ratio >= 1.4 else 3}).add(text(s)))
        else:
            d.root.add(Node("paragraph").add(text(s)))
    return d
