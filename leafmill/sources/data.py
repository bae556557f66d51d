"""Tabular, bibliographic, notebook and JSON formats."""

from __future__ import annotations

import json
import re

from ..model import Document, Node, Warning_, from_json, text
from .markup import front_matter  # noqa: F401


# -- tables -------------------------------------------------------------------


def split_line(line: str, sep: str) -> list[str]:
    """Cells of one line; quotes toggle anywhere and a doubled quote is one."""
    cells, cell, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = not quoted
        elif c == sep and not quoted:
            cells.append("".join(cell))
            cell = []
        else:
            cell.append(c)
        i += 1
    return [*cells, "".join(cell)]


def _delimited(sep: str, trim: bool):
    def parse(source: str) -> Document:
        table = Node("table")
        for line in source.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            if not line.strip():
                continue
            kind = "table_cell" if table.children else "table_header"
            cells = [c.strip() if trim else c for c in split_line(line, sep)]
            table.add(Node("table_row").add(*[Node(kind).add(*([text(c)] if c else [])) for c in cells]))
        return Document(Node("document").add(*([table] if table.children else [])))

    return parse


csv = _delimited(",", True)
tsv = _delimited("\t", False)


# -- bibliographies -----------------------------------------------------------

#: Roles of bibliography fields (fixed values).
ROLES = {
    "author": "author", "editor": "editor", "title": "title", "journal": "container_title", "journaltitle": "container_title",
    "booktitle": "container_title", "year": "date", "date": "date", "volume": "volume", "number": "issue", "issue": "issue",
    "pages": "pages", "publisher": "publisher", "address": "publisher_location", "location": "publisher_location",
    "doi": "identifier", "isbn": "identifier", "issn": "identifier", "url": "url", "edition": "edition", "note": "note",
    "abstract": "abstract", "keywords": "keyword",
}
RIS_ROLES = {
    "AU": "author", "A1": "author", "ED": "editor", "A2": "editor", "TI": "title", "T1": "title", "T2": "container_title", "JO": "container_title",
    "JF": "container_title", "PY": "date", "Y1": "date", "DA": "date", "VL": "volume", "IS": "issue", "SP": "page_first", "EP": "page_last",
    "PB": "publisher", "CY": "publisher_location", "DO": "identifier", "SN": "identifier", "UR": "url", "AB": "abstract", "KW": "keyword", "N1": "note",
}
CSL_ROLES = {
    "title": "title", "container-title": "container_title", "volume": "volume", "issue": "issue", "page": "pages", "publisher": "publisher",
    "publisher-place": "publisher_location", "DOI": "identifier", "ISBN": "identifier", "ISSN": "identifier", "URL": "url", "abstract": "abstract", "edition": "edition", "note": "note",
}


def _entry(kind: str, key: str | None, fields: list[tuple[str, str, str]]) -> Node:
    node = Node("bibliography_entry", {"entry:type": kind} | ({"id": key} if key else {}))
    for role, value, scheme in fields:
        props = {"field:role": role, "content": value} | ({"field:scheme": scheme} if scheme else {})
        if role == "date":
            m = re.match(r"(\d{4})(?:[-/](\d{1,2}))?(?:[-/](\d{1,2}))?", value)
            if m:
                props["date"] = {k: int(v) for k, v in zip(("year", "month", "day"), m.groups(), strict=True) if v}
        if role == "pages":
            for r, v in zip(("page_first", "page_last"), page_range(value), strict=True):
                if v:
                    node.add(Node("bibliography_field", {"field:role": r, "content": v}))
        node.add(Node("bibliography_field", props))
    return node


def page_range(value: str) -> tuple[str | None, str | None]:
    m = re.fullmatch(r"\s*(\d+)\s*(?:--|–|—|-)\s*(\d+)\s*", value)
    if m:
        return m[1], m[2]
    return (value.strip(), None) if value.strip().isdigit() else (None, None)


def _bibliography(entries: list[Node]) -> Document:
    return Document(Node("document").add(*([Node("bibliography").add(*entries)] if entries else [])))


def bibtex(source: str) -> Document:
    """Entries with braced, quoted or bare values; strings are expanded, comments skipped."""
    entries, at, strings, meta = [], 0, {}, {}
    for m in re.finditer(r"@(\w+)\s*[{(]", source):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while i < len(source) and depth:
            depth += {"{": 1, "(": 0, "}": -1}.get(source[i], 0)
            i += 1
        body, at, kind = source[m.end() : i - 1], i, m[1].lower()
        if kind in ("comment", "preamble"):
            continue
        key, _, rest = ("", "", body) if kind == "string" else body.partition(",")
        fields = []
        for name, value in _bib_fields(rest, strings):
            if kind == "string":
                strings[name.lower()] = value
                continue
            role = ROLES.get(name.lower(), name.lower())
            if role in ("author", "editor"):
                fields += [(role, x.strip(), "") for x in re.split(r"\s+and\s+", value) if x.strip()]
            elif role == "keyword":
                fields += [(role, x.strip(), "") for x in re.split(r"[,;]", value) if x.strip()]
            else:
                fields.append((role, value, name.lower() if role == "identifier" else ""))
        if kind != "string":
            entries.append(_entry(kind, key.strip(), fields))
    out = _bibliography(entries)
    out.metadata = meta
    return out


def _bib_fields(body: str, strings: dict):
    i = 0
    while m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, i):
        i, parts = m.end(), []
        while i < len(body):
            if body[i] in '{"':
                close, depth, j = ("}", 1, i + 1) if body[i] == "{" else ('"', 1, i + 1)
                while j < len(body):
                    if body[j] == "{" and close == "}":
                        depth += 1
                    elif body[j] == close:
                        depth -= 1
                        if not depth:
                            break
                    j += 1
                parts.append(body[i + 1 : j])
                i = j + 1
            else:
                w = re.compile(r"[^,#\s}]+").match(body, i)
                if not w:
                    break
                parts.append(strings.get(w[0].lower(), w[0]))
                i = w.end()
            glue = re.compile(r"\s*#\s*").match(body, i)
            if not glue:
                break
            i = glue.end()
        yield m[1], re.sub(r"\s+", " ", re.sub(r"[{}]", "", "".join(parts))).strip()


def ris(source: str) -> Document:
    entries, fields, kind, key = [], [], None, None
    for line in source.replace("\r", "").split("\n"):
        m = re.match(r"([A-Z][A-Z0-9])\s{2}-\s?(.*)$", line)
        if not m:
            continue
        tag, value = m[1], m[2].strip()
        if tag == "TY":
            fields, kind, key = [], value.lower() or "misc", None
        elif tag == "ER":
            if kind:
                entries.append(_entry(kind, key or _cite_key(fields), fields))
            fields, kind = [], None
        elif tag == "ID":
            key = value
        elif value:
            role = RIS_ROLES.get(tag, tag.lower())
            fields.append((role, value, {"DO": "doi", "SN": "issn"}.get(tag, "")))
    if kind:
        entries.append(_entry(kind, key or _cite_key(fields), fields))
    return _bibliography(entries)


def _cite_key(fields) -> str:
    get = lambda role: next((v for r, v, _ in fields if r == role), "")
    name = re.split(r"[,\s]", get("author"))[0].lower() or "anon"
    year = re.search(r"\d{4}", get("date"))
    return re.sub(r"\W", "", name) + (year[0] if year else "")


def csl_json(source: str) -> Document:
    data = json.loads(source or "[]")
    entries = []
    for e in data if isinstance(data, list) else [data]:
        fields = []
        for role in ("author", "editor"):
            for p in e.get(role) or []:
                name = p.get("literal") or ", ".join(x for x in (p.get("family"), p.get("given")) if x)
                fields.append((role, name, ""))
        parts = ((e.get("issued") or {}).get("date-parts") or [[]])[0]
        if parts:
            fields.append(("date", "-".join(f"{int(x):02d}" for x in parts), ""))
        for k, role in CSL_ROLES.items():
            if e.get(k) is not None:
                fields.append((role, str(e[k]), k.lower() if role == "identifier" else ""))
        entries.append(_entry(e.get("type", "misc"), str(e["id"]) if "id" in e else None, fields))
    return _bibliography(entries)


def endnotexml(source: str) -> Document:
    import xml.etree.ElementTree as ET

    entries = []
    for rec in ET.fromstring(source).iter("record"):
        txt = lambda path: " ".join("".join(rec.find(path).itertext()).split()) if rec.find(path) is not None else ""  # noqa: E731, B023
        fields = [("author", "".join(a.itertext()).strip(), "") for a in rec.iterfind("contributors/authors/author")]
        fields += [("editor", "".join(a.itertext()).strip(), "") for a in rec.iterfind("contributors/secondary-authors/author")]
        for path, role in (("titles/title", "title"), ("titles/secondary-title", "container_title"), ("dates/year", "date"), ("volume", "volume"), ("number", "issue"), ("pages", "pages"), ("publisher", "publisher"), ("isbn", "identifier"), ("electronic-resource-num", "identifier"), ("abstract", "abstract"), ("urls/related-urls/url", "url")):
            if txt(path):
                fields.append((role, txt(path), ""))
        kind = rec.find("ref-type")
        entries.append(_entry((kind.get("name") if kind is not None else None) or "misc", txt("rec-number") or None, fields))
    return _bibliography(entries)


# -- JSON ---------------------------------------------------------------------


def ipynb(source: str) -> Document:
    from .formats import parse as markup

    nb = json.loads(source)
    meta = nb.get("metadata") or {}
    lang = (meta.get("language_info") or {}).get("name") or (meta.get("kernelspec") or {}).get("language") or "python"
    join = lambda s: "".join(s) if isinstance(s, list) else s or ""
    d = Document(Node("document"), {"language": lang})
    for cell in nb.get("cells") or []:
        body, kind = join(cell.get("source")), cell.get("cell_type")
        if kind == "markdown":
            d.root.add(*markup("markdown", body).root.children)
        elif kind == "code":
            d.root.add(Node("code_block", {"content": body, "language": lang}))
            for out in cell.get("outputs") or []:
                shown = join(out.get("text")) or join((out.get("data") or {}).get("text/plain")) or "\n".join(out.get("traceback") or [])
                if shown:
                    clean = re.sub("\x1b\\[[0-9;?]*[ -/]*[@-~]", "", shown)
                    d.root.add(Node("div", {"classes": "output"}).add(Node("code_block", {"content": clean})))
        elif kind == "raw":
            d.root.add(Node("raw_block", {"content": body, "format": (cell.get("metadata") or {}).get("format", "text")}))
        else:
            d.warnings.append(Warning_("minor", "UnsupportedNode", str(kind), "unknown cell type"))
    return d


#: Pandoc element names to node kinds (fixed values).
PANDOC = {
    "Para": "paragraph", "Plain": "paragraph", "BlockQuote": "blockquote", "HorizontalRule": "horizontal_rule", "Emph": "emphasis", "Strong": "strong",
    "Strikeout": "strikeout", "Underline": "underline", "Superscript": "superscript", "Subscript": "subscript", "SmallCaps": "small_caps",
}


def pandoc_json(source: str) -> Document:
    data = json.loads(source)
    d = Document(Node("document"))
    d.metadata = {k: _meta(v) for k, v in (data.get("meta") or {}).items()}
    d.root.add(*_pandoc_all(data.get("blocks") or [], d))
    return d


def _meta(v):
    t, c = v.get("t"), v.get("c")
    if t in ("MetaInlines", "MetaBlocks"):
        return Node("x").add(*_pandoc_all(c, Document(Node("x")))).text()
    if t == "MetaList":
        return [_meta(x) for x in c]
    if t == "MetaMap":
        return {k: _meta(x) for k, x in c.items()}
    return c


def _attr(a) -> dict:
    props = {}
    if a and a[0]:
        props["id"] = a[0]
    if a and a[1]:
        props["classes"] = " ".join(a[1])
    return props


def _pandoc_all(items, d: Document) -> list[Node]:
    out: list[Node] = []
    for x in items:
        for n in _pandoc(x, d):
            if n.kind == "text" and out and out[-1].kind == "text":
                out[-1].props["content"] += n.props["content"]
            else:
                out.append(n)
    return out


def _pandoc(x: dict, d: Document) -> list[Node]:
    t, c = x.get("t"), x.get("c")
    go = lambda items: _pandoc_all(items, d)
    if t == "Str":
        return [text(c)]
    if t == "Space":
        return [text(" ")]
    if t in ("SoftBreak", "LineBreak"):
        return [Node("soft_break" if t == "SoftBreak" else "line_break")]
    if t in PANDOC:
        return [Node(PANDOC[t]).add(*(go(c) if isinstance(c, list) else []))]
    if t == "Header":
        return [Node("heading", {"level": c[0], **_attr(c[1])}).add(*go(c[2]))]
    if t == "CodeBlock":
        lang = c[0][1][0] if c[0][1] else None
        return [Node("code_block", {"content": c[1]} | ({"language": lang} if lang else {}))]
    if t == "Code":
        return [Node("code", {"content": c[1]})]
    if t == "BulletList":
        return [Node("list", {"ordered": False}).add(*[Node("list_item").add(*go(i)) for i in c])]
    if t == "OrderedList":
        start = {"start": c[0][0]} if c[0][0] != 1 else {}
        return [Node("list", {"ordered": True, **start}).add(*[Node("list_item").add(*go(i)) for i in c[1]])]
    if t == "DefinitionList":
        node = Node("definition_list")
        for term, descs in c:
            node.add(Node("definition_term").add(*go(term)), *[Node("definition_desc").add(*go(b)) for b in descs])
        return [node]
    if t in ("Link", "Image"):
        props = {"url": c[2][0]} | ({"title": c[2][1]} if c[2][1] else {})
        inner = go(c[1])
        if t == "Image":
            alt = Node("x").add(*inner).text()
            return [Node("image", props | ({"alt": alt} if alt else {}))]
        return [Node("link", props).add(*inner)]
    if t == "Quoted":
        return [Node("quoted", {"quote_type": "single" if c[0].get("t") == "SingleQuote" else "double"}).add(*go(c[1]))]
    if t == "Math":
        return [Node("math_display" if c[0].get("t") == "DisplayMath" else "math_inline", {"math:source": c[1]})]
    if t in ("RawInline", "RawBlock"):
        return [Node("raw_inline" if t == "RawInline" else "raw_block", {"format": c[0], "content": c[1]})]
    if t == "Note":
        return [Node("footnote_def").add(*go(c))]
    if t in ("Span", "Div"):
        return [Node(t.lower(), _attr(c[0])).add(*go(c[1]))]
    if t == "Cite":
        return [Node("cite", {"id": c[0][0]["citationId"]} if c[0] else {}).add(*go(c[1]))]
    if t == "LineBlock":
        return [Node("div", {"classes": "line-block"}).add(*[Node("paragraph").add(*go(i)) for i in c])]
    if t == "Figure":
        return [Node("figure", _attr(c[0])).add(*go(c[2]))]
    if t == "Table":
        return [_pandoc_table(c, go)]
    if t != "Null":
        d.warnings.append(Warning_("minor", "UnsupportedNode", str(t)))
    return []


def _pandoc_table(c, go) -> Node:
    table = Node("table")

    def row(cells, kind):
        # A cell of one plain block holds its inlines directly.
        bare = lambda b: b[0]["c"] if len(b) == 1 and b[0].get("t") == "Plain" else b
        table.add(Node("table_row").add(*[Node(kind).add(*go(bare(cell[4]))) for cell in cells]))

    for r in c[3][1]:
        row(r[1], "table_header")
    for body in c[4]:
        for r in body[2] + body[3]:
            row(r[1], "table_cell")
    for r in c[5][1]:
        row(r[1], "table_cell")
    return table


def native(source: str) -> Document:
    """The tree as the engine prints it: JSON, or ``kind( { key: value }) [ children ]`` lines."""
    if source.lstrip().startswith("{"):
        data = json.loads(source)
        d = Document(from_json(data.get("content") or data))
        d.metadata = data.get("metadata") or {}
        return d
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|[\w:.-]+|[][(){},]', source)
    at = 0

    def value():
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "{":
            out = {}
            while tokens[at] != "}":
                key = tokens[at].rstrip(":")
                at += 1
                out[json.loads(key) if key[0] == '"' else key] = value()
                at += tokens[at] == ","
            at += 1
            return out
        if t == "[":
            items = []
            while tokens[at] != "]":
                items.append(value())
                at += tokens[at] == ","
            at += 1
            return items
        if t[0] == '"':
            return json.loads(t)
        if t in ("true", "false"):
            return t == "true"
        return float(t) if "." in t else int(t) if t.lstrip("-").isdigit() else t

    def node() -> Node:
        nonlocal at
        out = Node(tokens[at])
        at += 1
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            if tokens[at] == "{":
                out.props = value()
            while tokens[at] != ")":
                at += 1
            at += 1
        if at < len(tokens) and tokens[at] == "[":
            at += 1
            while tokens[at] != "]":
                out.add(node())
                at += tokens[at] == ","
            at += 1
        return out

    d = Document(Node("document"))
    if tokens[:3] == ["Document", "{", "content:"]:
        at = 3
        d.root = node()
        if at < len(tokens) and tokens[at] == "metadata:":
            at += 1
            found = value()
            d.metadata = found if isinstance(found, dict) else {}
    elif tokens:
        raise ValueError("not a document")
    return d


def ansi(source: str) -> Document:
    """Terminal output: styles become nested nodes, links and newlines are kept, cursor moves are dropped."""
    kinds = {1: "strong", 3: "emphasis", 4: "underline", 8: "hidden", 9: "strikeout"}
    off = {22: 1, 23: 3, 24: 4, 28: 8, 29: 9}
    para, on, d = Node("paragraph"), [], Document(Node("document"))
    link = None
    for m in re.finditer(r"\x1b\[([0-9;]*)m|\x1b\]8;[^;]*;(.*?)(?:\x1b\\|\x07)|\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b.|(\n)|([^\x1b\n]+)", source):
        if m[1] is not None:
            for code in [int(x or 0) for x in m[1].split(";")]:
                if code == 0:
                    on = []
                elif code in kinds:
                    on.append(code)
                elif code in off and off[code] in on:
                    on.remove(off[code])
        elif m[2] is not None:
            link = m[2] or None
        elif m[3]:
            if para.children:
                para.add(Node("line_break"))
        elif m[4]:
            node = text(m[4])
            for code in reversed(list(dict.fromkeys(on))):
                node = Node(kinds[code]).add(node)
            para.add(Node("link", {"url": link}).add(node) if link else node)
    while para.children and para.children[-1].kind == "line_break":
        para.children.pop()
    if para.children:
        d.root.add(para)
    return d


def rtf(source) -> Document:
    """Paragraphs and character styles of rich text."""
    if isinstance(source, (bytes, bytearray)):
        source = bytes(source).decode("latin-1")
    d, para, state, stack = Document(Node("document")), Node("paragraph"), {}, []
    kinds = {"b": "strong", "i": "emphasis", "ul": "underline", "strike": "strikeout", "super": "superscript", "sub": "subscript", "scaps": "small_caps", "caps": "all_caps", "v": "hidden"}
    skipped = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator", "listtable", "listoverridetable", "header", "footer", "xmlnstbl", "themedata"}

    def put(s: str) -> None:
        if state.get("skip") or not s:
            return
        on = [k for k in kinds if state.get(k)]
        last = para.children[-1] if para.children else None
        if last is not None and last.kind == "text" and not on:
            last.props["content"] += s
            return
        node = text(s)
        for k in reversed(on):
            node = Node(kinds[k]).add(node)
        para.add(node)

    def end() -> None:
        nonlocal para
        if para.children:
            d.root.add(Node("heading", {"level": state["outlinelevel"] + 1}).add(*para.children) if "outlinelevel" in state else para)
        para = Node("paragraph")

    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", source, re.S):
        word, num = m[1], m[2]
        if word:
            if word in ("par", "sect", "page"):
                end()
            elif word in ("line", "tab"):
                put("\n" if word == "line" else "\t")
            elif word == "pard":
                state.pop("outlinelevel", None)
            elif word == "plain":
                for k in kinds:
                    state.pop(k, None)
            elif word == "outlinelevel" and num:
                state["outlinelevel"] = max(0, min(5, int(num)))
            elif word in ("ulnone", "nosupersub"):
                for k in ("ul",) if word == "ulnone" else ("super", "sub"):
                    state[k] = False
            elif word in kinds:
                state[word] = num != "0"
            elif word == "u" and num:
                put(chr(int(num) % 65536))
            elif word in skipped:
                state["skip"] = True
            elif word in ("emdash", "endash", "lquote", "rquote", "ldblquote", "rdblquote", "bullet"):
                put({"emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}[word])
        elif m[3]:
            put(bytes([int(m[3], 16)]).decode("cp1252", "replace"))
        elif m[4]:
            if m[4] == "*":
                state["skip"] = True
            elif m[4] == "~":
                put("\u00a0")
            elif m[4] in "\\{}":
                put(m[4])
        elif m[5] == "{":
            stack.append(dict(state))
        elif m[5] == "}":
            state = stack.pop() if stack else {}
        elif m[6]:
            put(m[6])
    end()
    return d
