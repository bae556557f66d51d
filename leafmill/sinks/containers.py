"""Zip containers written from trees; bytes, with a fixed timestamp so output is reproducible."""

from __future__ import annotations

import io
import zipfile

from ..model import Document, Node
from .styles import STYLES, Emitter, attr_escape, xml_escape

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
APP = "application/vnd.openxmlformats-officedocument"


def _zip(files: dict[str, str], stored: tuple[str, ...] = ()) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, body)
    return out.getvalue()


def _package(main: str, kind: str, parts: dict[str, tuple[str, str]], rels: dict[str, list[tuple[str, str, str]]]) -> bytes:
    """``parts``: name to (content type, body); ``rels``: part to (id, type, target)."""
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, (t, _) in parts.items())
    files = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": _rels([("rId1", "officeDocument", main)]),
    }
    files |= {n: HEAD + b for n, (_, b) in parts.items()}
    for part, own in rels.items():
        folder, _, base = part.rpartition("/")
        files[f"{folder}/_rels/{base}.rels"] = _rels(own)
    return _zip(files)


def _rels(items) -> str:
    body = "".join(
        f'<Relationship Id="{i}" Type="{OFFICE}/relationships/{k}" Target="{attr_escape(t)}"' + (' TargetMode="External"' if k == "hyperlink" else "") + "/>" for i, k, t in items
    )
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{body}</Relationships>'


_RUN = {"strong": "<w:b/>", "emphasis": "<w:i/>", "underline": '<w:u w:val="single"/>', "strikeout": "<w:strike/>", "small_caps": "<w:smallCaps/>", "all_caps": "<w:caps/>", "hidden": "<w:vanish/>", "superscript": '<w:vertAlign w:val="superscript"/>', "subscript": '<w:vertAlign w:val="subscript"/>'}


def docx(doc: Document) -> bytes:
    links: list[tuple[str, str, str]] = []

    def runs(nodes: list[Node], props: str = "") -> str:
        out = []
        for n in nodes:
            if n.kind in ("text", "code"):
                out.append(f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{xml_escape(str(n.props.get("content", "")))}</w:t></w:r>')
            elif n.kind == "line_break":
                out.append("<w:r><w:br/></w:r>")
            elif n.kind == "soft_break":
                out.append('<w:r><w:t xml:space="preserve"> </w:t></w:r>')
            elif n.kind == "link":
                links.append((f"rId{len(links) + 10}", "hyperlink", str(n.props.get("url", ""))))
                out.append(f'<w:hyperlink r:id="{links[-1][0]}">{runs(n.children, props)}</w:hyperlink>')
            else:
                out.append(runs(n.children, props + _RUN.get(n.kind, "")))
        return "".join(out)

    def para(nodes: list[Node], style: str = "", extra: str = "") -> str:
        pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p>{f'<w:pPr>{pr}</w:pPr>' if pr else ''}{runs(nodes)}</w:p>"

    def blocks(nodes: list[Node], style: str = "") -> str:
        out = []
        for n in nodes:
            if n.kind == "heading":
                out.append(para(n.children, f"Heading{n.props.get('level', 1)}"))
            elif n.kind == "code_block":
                out += [para([Node("text", {"content": line})], "Code") for line in str(n.props.get("content", "")).split("\n")]
            elif n.kind == "blockquote":
                out.append(blocks(n.children, "Quote"))
            elif n.kind == "list":
                num = f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{2 if n.props.get("ordered") else 1}"/></w:numPr>'
                for i in n.children:
                    for c in i.children:
                        out.append(blocks([c]) if c.kind == "list" else para(c.children if c.kind == "paragraph" else [c], "", num))
            elif n.kind == "table":
                rows = "".join("<w:tr>" + "".join(f"<w:tc>{blocks(c.children) if any(x.kind == 'paragraph' for x in c.children) else para(c.children)}</w:tc>" for c in r.children) + "</w:tr>" for r in n.walk() if r.kind == "table_row")
                out.append(f"<w:tbl>{rows}</w:tbl>")
            elif n.kind in ("paragraph", "definition_term", "definition_desc", "caption"):
                out.append(para(n.children, style) if not any(c.kind == "paragraph" for c in n.children) else blocks(n.children, style))
            elif n.kind in ("text", "strong", "emphasis", "link", "code", "span"):
                out.append(para([n], style))
            else:
                out.append(blocks(n.children, style))
        return "".join(out)

    body = blocks(doc.root.children)
    ns = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="{OFFICE}/relationships"'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum>' for i, f in ((1, "bullet"), (2, "decimal"))) + "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i in (1, 2))
    parts = {
        "word/document.xml": (f"{APP}.wordprocessingml.document.main+xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>"),
        "word/numbering.xml": (f"{APP}.wordprocessingml.numbering+xml", f"<w:numbering {ns}>{numbering}</w:numbering>"),
    }
    return _package("word/document.xml", "docx", parts, {"word/document.xml": [("rId1", "numbering", "numbering.xml"), *links]})


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(doc: Document) -> bytes:
    """Sheets, or tables as sheets where there are none."""
    sheets = [n for n in doc.root.walk() if n.kind == "sheet"] or [n for n in doc.root.walk() if n.kind == "table"] or [Node("sheet")]
    parts, rels, listed = {}, [], []
    for k, s in enumerate(sheets, 1):
        rows = []
        for r, row in enumerate((x for x in s.walk() if x.kind in ("sheet_row", "table_row")), 1):
            cells = []
            for c, cell in enumerate(row.children, 1):
                kind, value = cell.props.get("value:type", "string"), str(cell.props.get("value:data", cell.text()))
                if not value:
                    continue
                ref = f"{_letters(c)}{r}"
                formula = f"<f>{xml_escape(str(cell.props['value:formula']))}</f>" if cell.props.get("value:formula") is not None else ""
                numeric = kind != "string" and kind != "boolean" and value.replace(".", "", 1).lstrip("-").isdigit()
                if numeric:
                    cells.append(f'<c r="{ref}">{formula}<v>{value}</v></c>')
                elif kind == "boolean":
                    cells.append(f'<c r="{ref}" t="b">{formula}<v>{int(value == "TRUE")}</v></c>')
                else:
                    cells.append(f'<c r="{ref}" t="inlineStr">{formula}<is><t xml:space="preserve">{xml_escape(value)}</t></is></c>')
            rows.append(f'<row r="{r}">{"".join(cells)}</row>')
        name = attr_escape(str(s.props.get("title") or f"Sheet{k}"))
        parts[f"xl/worksheets/sheet{k}.xml"] = (f"{APP}.spreadsheetml.worksheet+xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>')
        rels.append((f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml"))
        listed.append(f'<sheet name="{name}" sheetId="{k}" r:id="rId{k}"/>')
    book = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{OFFICE}/relationships"><sheets>{"".join(listed)}</sheets></workbook>'
    return _package("xl/workbook.xml", "xlsx", {"xl/workbook.xml": (f"{APP}.spreadsheetml.sheet.main+xml", book), **parts}, {"xl/workbook.xml": rels})


def pptx(doc: Document) -> bytes:
    """A slide per slide div, or per heading of level 1 or 2."""
    slides = [n.children for n in doc.root.children if n.kind == "div" and n.props.get("classes") == "slide"]
    if not slides:
        slides = [[]]
        for b in doc.root.children:
            if b.kind == "heading" and b.props.get("level", 1) <= 2 and slides[-1]:
                slides.append([])
            slides[-1].append(b)
    ns = f'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{OFFICE}/relationships"'
    parts, rels = {}, []
    for k, blocks in enumerate(slides, 1):
        shapes = []
        for b in blocks:
            ph = '<p:nvPr><p:ph type="title"/></p:nvPr>' if b.kind == "heading" else "<p:nvPr/>"
            shapes.append(f"<p:sp><p:nvSpPr>{ph}</p:nvSpPr><p:txBody><a:p><a:r><a:t>{xml_escape(b.text())}</a:t></a:r></a:p></p:txBody></p:sp>")
        parts[f"ppt/slides/slide{k}.xml"] = (f"{APP}.presentationml.slide+xml", f'<p:sld {ns}><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>')
        rels.append((f"rId{k}", "slide", f"slides/slide{k}.xml"))
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
    main = f"<p:presentation {ns}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    return _package("ppt/presentation.xml", "pptx", {"ppt/presentation.xml": (f"{APP}.presentationml.presentation.main+xml", main), **parts}, {"ppt/presentation.xml": rels})


def odt(doc: Document) -> bytes:
    def inl(nodes: list[Node]) -> str:
        out = []
        for n in nodes:
            if n.kind in ("text", "code"):
                out.append(xml_escape(str(n.props.get("content", ""))))
            elif n.kind == "line_break":
                out.append("<text:line-break/>")
            elif n.kind == "soft_break":
                out.append(" ")
            elif n.kind == "link":
                out.append(f'<text:a xlink:href="{attr_escape(str(n.props.get("url", "")))}">{inl(n.children)}</text:a>')
            elif n.kind in ("strong", "emphasis", "underline", "strikeout", "superscript", "subscript"):
                out.append(f'<text:span text:style-name="{n.kind}">{inl(n.children)}</text:span>')
            else:
                out.append(inl(n.children))
        return "".join(out)

    def blocks(nodes: list[Node]) -> str:
        out = []
        for n in nodes:
            if n.kind == "heading":
                out.append(f'<text:h text:outline-level="{n.props.get("level", 1)}">{inl(n.children)}</text:h>')
            elif n.kind == "list":
                out.append("<text:list>" + "".join(f"<text:list-item>{blocks(i.children)}</text:list-item>" for i in n.children) + "</text:list>")
            elif n.kind == "table":
                rows = "".join("<table:table-row>" + "".join(f"<table:table-cell>{blocks([Node('paragraph').add(*c.children)])}</table:table-cell>" for c in r.children) + "</table:table-row>" for r in n.walk() if r.kind == "table_row")
                out.append(f"<table:table>{rows}</table:table>")
            elif n.kind == "code_block":
                out.append(f"<text:p>{xml_escape(str(n.props.get('content', '')))}</text:p>")
            elif any(c.kind in ("paragraph", "list", "table", "heading") for c in n.children):
                out.append(blocks(n.children))
            else:
                out.append(f"<text:p>{inl(n.children or [n])}</text:p>")
        return "".join(out)

    looks = {"strong": 'fo:font-weight="bold"', "emphasis": 'fo:font-style="italic"', "underline": 'style:text-underline-style="solid"', "strikeout": 'style:text-line-through-style="solid"', "superscript": 'style:text-position="super 58%"', "subscript": 'style:text-position="sub 58%"'}
    o = "urn:oasis:names:tc:opendocument:xmlns:"
    ns = f'xmlns:office="{o}office:1.0" xmlns:text="{o}text:1.0" xmlns:table="{o}table:1.0" xmlns:style="{o}style:1.0" xmlns:fo="{o}xsl-fo-compatible:1.0" xmlns:xlink="http://www.w3.org/1999/xlink"'
    styles = "".join(f'<style:style style:name="{k}" style:family="text"><style:text-properties {v}/></style:style>' for k, v in looks.items())
    content = f"{HEAD}<office:document-content {ns}><office:automatic-styles>{styles}</office:automatic-styles><office:body><office:text>{blocks(doc.root.children)}</office:text></office:body></office:document-content>"
    manifest = f'{HEAD}<manifest:manifest xmlns:manifest="{o}manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.text"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": content, "META-INF/manifest.xml": manifest}, ("mimetype",))


def epub(doc: Document) -> bytes:
    body = "\n".join(Emitter(STYLES["html"]).blocks(doc.root.children)).replace("<br>", "<br/>").replace("<hr>", "<hr/>")
    title = xml_escape(str(doc.metadata.get("title", "Untitled")))
    page = f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>{body}</body></html>'
    opf = f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:leafmill</dc:identifier><dc:title>{title}</dc:title><dc:language>{xml_escape(str(doc.metadata.get("language", "en")))}</dc:language></metadata><manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c1"/></spine></package>'
    box = f'{HEAD}<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return _zip({"mimetype": "application/epub+zip", "META-INF/container.xml": box, "OEBPS/content.opf": opf, "OEBPS/c1.xhtml": page}, ("mimetype",))


WRITERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odt": odt, "epub": epub}
