"""Tables and bibliographies as text."""

from __future__ import annotations

import json

from ..model import Document, Node


def _rows(doc: Document) -> list[list[str]]:
    """Cells of the first table in pre-order."""
    table = next((n for n in doc.root.walk() if n.kind == "table"), None)
    return [[c.text() for c in r.children] for r in table.walk() if r.kind == "table_row"] if table else []


def _delimited(sep: str):
    def write(doc: Document) -> str:
        quote = lambda s: '"' + s.replace('"', '""') + '"' if any(c in s for c in (sep, '"', "\n")) else s
        return "".join(sep.join(map(quote, r)) + "\n" for r in _rows(doc))

    return write


def _entries(doc: Document):
    for e in doc.root.walk():
        if e.kind == "bibliography_entry":
            yield e, [(f.props.get("field:role", ""), str(f.props.get("content", "")), f.props.get("field:scheme")) for f in e.children if f.kind == "bibliography_field"]


def _bibtex(doc: Document) -> str:
    names = {"container_title": "journal", "issue": "number", "publisher_location": "address", "date": "year", "keyword": "keywords"}
    out = []
    for e, fields in _entries(doc):
        grouped: dict[str, list[str]] = {}
        for role, value, scheme in fields:
            if role not in ("page_first", "page_last"):
                grouped.setdefault(scheme or names.get(role, role), []).append(value)
        body = ",\n".join(f"  {k} = {{{(' and ' if k in ('author', 'editor') else ', ').join(v)}}}" for k, v in grouped.items())
        out.append(f"@{e.props.get('entry:type', 'misc')}{{{e.props.get('id', '')},\n{body}\n}}\n")
    return "\n".join(out)


def _ris(doc: Document) -> str:
    tags = {"author": "AU", "editor": "ED", "title": "TI", "container_title": "T2", "date": "PY", "volume": "VL", "issue": "IS", "page_first": "SP", "page_last": "EP", "publisher": "PB", "publisher_location": "CY", "identifier": "DO", "url": "UR", "abstract": "AB", "keyword": "KW", "note": "N1"}
    out = []
    for e, fields in _entries(doc):
        out.append(f"TY  - {str(e.props.get('entry:type', 'GEN')).upper()}")
        out += [f"{tags[r]}  - {v}" for r, v, _ in fields if r in tags]
        out.append("ER  - \n")
    return "\n".join(out)


def _csl(doc: Document) -> str:
    names = {"container_title": "container-title", "pages": "page", "publisher_location": "publisher-place", "identifier": "DOI", "url": "URL"}
    out = []
    for e, fields in _entries(doc):
        item: dict = {"id": e.props.get("id", ""), "type": e.props.get("entry:type", "misc")}
        for role, value, _ in fields:
            if role in ("author", "editor"):
                family, _, given = value.partition(", ")
                item.setdefault(role, []).append({"family": family, "given": given} if given else {"literal": value})
            elif role == "date":
                item["issued"] = {"date-parts": [[int(x) for x in value.split("-") if x.isdigit()]]}
            elif role not in ("page_first", "page_last"):
                item[names.get(role, role)] = value
        out.append(item)
    return json.dumps(out, ensure_ascii=False, indent=2) + "\n"


def _endnote(doc: Document) -> str:
    from .styles import attr_escape, xml_escape

    out = ["<xml><records>"]
    for e, fields in _entries(doc):
        by = lambda role: [xml_escape(v) for r, v, _ in fields if r == role]  # noqa: E731, B023
        out.append(f'<record><ref-type name="{attr_escape(str(e.props.get("entry:type", "")))}"/><contributors><authors>' + "".join(f"<author>{a}</author>" for a in by("author")) + "</authors></contributors><titles>" + "".join(f"<title>{t}</title>" for t in by("title")) + "</titles>" + "".join(f"<dates><year>{t}</year></dates>" for t in by("date")[:1]) + "</record>")
    return "\n".join(out) + "\n</records></xml>\n"


def _opml(doc: Document) -> str:
    from .styles import attr_escape, xml_escape

    def outline(node: Node) -> str:
        out = []
        for item in node.children:
            if item.kind != "list_item":
                continue
            label = " ".join(c.text() for c in item.children if c.kind != "list")
            inner = "".join(outline(c) for c in item.children if c.kind == "list")
            out.append(f'<outline text="{attr_escape(label)}">{inner}</outline>' if inner else f'<outline text="{attr_escape(label)}"/>')
        return "\n".join(out)

    body = "\n".join(outline(n) if n.kind == "list" else f'<outline text="{attr_escape(n.text())}"/>' for n in doc.root.children)
    return f'<?xml version="1.0"?>\n<opml version="2.0"><head><title>{xml_escape(str(doc.metadata.get("title", "")))}</title></head><body>\n{body}\n</body></opml>\n'


WRITERS = {"csv": _delimited(","), "tsv": _delimited("\t"), "bibtex": _bibtex, "biblatex": _bibtex, "ris": _ris, "csl-json": _csl, "endnotexml": _endnote, "opml": _opml}
