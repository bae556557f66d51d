"""Slide decks and chunked pages: trees split at headings."""

from __future__ import annotations

from ..model import Document, Node
from .styles import STYLES, Emitter, xml_escape


def split(blocks: list[Node], most: int) -> list[list[Node]]:
    """A new part at each top-level heading of ``most`` or less; what stands before the first is dropped."""
    parts: list[list[Node]] = []
    for b in blocks:
        if b.kind == "heading" and b.props.get("level", 1) <= most:
            parts.append([])
        if parts:
            parts[-1].append(b)
    return parts


def split_nonempty(blocks: list[Node]) -> list[list[Node]]:
    """A new part at each level-1 heading unless the current one is empty; nothing is dropped."""
    parts: list[list[Node]] = [[]]
    for b in blocks:
        if b.kind == "heading" and b.props.get("level", 1) == 1 and parts[-1]:
            parts.append([])
        parts[-1].append(b)
    return [p for p in parts if p]


def _deck(item: str, head: str, foot: str):
    def write(doc: Document) -> str:
        e = Emitter(STYLES["html"])
        body = "\n".join(item.replace("{t}", "\n".join(e.blocks(p))) for p in split(doc.root.children, 2))
        title = xml_escape(str(doc.metadata.get("title", "")))
        return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{title}</title>{head}</head>\n<body>{foot.split('|')[0]}\n{body}\n{foot.split('|')[1]}</body></html>\n"

    return write


def _slideous(doc: Document) -> str:
    e = Emitter(STYLES["html"])
    meta = {k: xml_escape(str(doc.metadata.get(k, ""))) for k in ("title", "author", "date")}
    first = f'<div class="slide titlepage"><h1>{meta["title"]}</h1><p>{meta["author"]} {meta["date"]}</p></div>'
    body = "\n".join('<div class="slide">\n' + "\n".join(e.blocks(p)) + "\n</div>" for p in split_nonempty(doc.root.children))
    return f"<!DOCTYPE html>\n<html><head><title>{meta['title']}</title></head>\n<body>\n{first}\n{body}\n</body></html>\n"


def _beamer(doc: Document) -> str:
    e, out = Emitter(STYLES["latex"]), []
    for p in split(doc.root.children, 2):
        title = e.inlines(p[0].children)
        out.append("\\begin{frame}{" + title + "}\n" + "\n\n".join(e.blocks(p[1:])) + "\n\\end{frame}")
    return "\\documentclass{beamer}\n\\begin{document}\n" + "\n".join(out) + "\n\\end{document}\n"


def chunks(doc: Document) -> list[tuple[str, str, str]]:
    """``(file, title, html)`` of each chunk, after an index of the top-level headings."""
    e = Emitter(STYLES["html"])
    parts = split_nonempty(doc.root.children)
    names = [f"chunk{i:03d}.html" for i in range(1, len(parts) + 1)]
    made, links, seen = [], [], 0
    for name, p in zip(names, parts, strict=True):
        title = p[0].text() if p[0].kind == "heading" else ""
        made.append((name, title, "\n".join(e.blocks(p)) + "\n"))
    for b in doc.root.children:
        if b.kind == "heading":
            seen += b.props.get("level", 1) == 1
            at = max(seen, 1) - 1
            links.append(f'<li class="l{b.props.get("level", 1)}"><a href="{names[min(at, len(names) - 1)]}">{xml_escape(b.text())}</a></li>')
    return [("index.html", "", "<ul>\n" + "\n".join(links) + "\n</ul>\n"), *made]


WRITERS = {
    "revealjs": _deck("<section>\n{t}\n</section>", '<link rel="stylesheet" href="reveal.css">', '<div class="reveal"><div class="slides">|</div></div><script src="reveal.js"></script>'),
    "slidy": _deck('<div class="slide">\n{t}\n</div>', '<link rel="stylesheet" href="slidy.css">', "|"),
    "s5": _deck('<div class="slide">\n{t}\n</div>', '<meta name="generator" content="S5">', '<div class="presentation">|</div>'),
    "dzslides": _deck("<section>\n{t}\n</section>", "", "|"),
    "slideous": _slideous,
    "beamer": _beamer,
    "chunkedhtml": lambda d: "".join(f"<!-- {n} -->\n{t}" for n, _, t in chunks(d)),
}
