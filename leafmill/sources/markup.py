"""One engine for line-oriented markup, driven by a description per format.

A format names its block rules and inline marks; the engine does paragraphs,
headings, lists by depth, code, quotes, tables, rules and definition lists,
and splits inline text.  Parsing never fails: what no rule knows is text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..model import Document, Node

# An inline rule: pattern with a group for the content, the node kind, and what fills the node.
Inline = tuple[str, str, dict]


@dataclass
class Markup:
    """The rules of one format."""

    name: str
    #: (pattern, level) -- level is a number, or a function of the match; group "t" is the title.
    headings: list = field(default_factory=list)
    #: Characters that underline a heading, in order of level.
    underlines: str = ""
    #: Whether the underline's level follows first use.
    adaptive: bool = False
    #: (opening pattern, closing pattern, kind); group "lang" is the language.
    fences: list = field(default_factory=list)
    #: (pattern, ordered) -- group "m" is the marker whose length or indent gives the depth; group "t" the item.
    items: list = field(default_factory=list)
    depth: str = "indent"
    quote: str = ""
    rule: str = ""
    #: (row pattern, cell separator, header cell mark)
    table: tuple | None = None
    #: pattern with groups "k" and "t"
    definition: str = ""
    #: lines dropped, or kept as metadata with groups "key" and "value"
    comments: str = ""
    meta: str = ""
    inlines: list[Inline] = field(default_factory=list)
    escape: str = ""
    indented_code: bool = False
    break_mark: str = ""
    front_matter: bool = False


def _link(m) -> tuple[str, str]:
    d = m.groupdict()
    url = d.get("url") or ""
    return url, d.get("label") or url


class Parser:
    def __init__(self, rules: Markup):
        self.r = rules
        self.flags = re.M
        names, parts = [], []
        for i, (pattern, kind, props) in enumerate(rules.inlines):
            # Names of groups inside a rule become unique over all rules.
            own = re.sub(r"\(\?P<(\w+)>", rf"(?P<g{i}_\1>", pattern)
            parts.append(f"(?P<r{i}>" + re.sub(r"\(\?P=(\w+)\)", rf"(?P=g{i}_\1)", own) + ")")
            names.append((kind, props))
        self.inline_rules = names
        self.inline_re = re.compile("|".join(parts), re.S | re.M) if parts else None
        self.head = [(re.compile(p), lv) for p, lv in rules.headings]
        self.fence = [(re.compile(a), re.compile(b), k) for a, b, k in rules.fences]
        self.item = [(re.compile(p), o) for p, o in rules.items]
        self.quote = re.compile(rules.quote) if rules.quote else None
        self.rule = re.compile(rules.rule) if rules.rule else None
        self.row = re.compile(rules.table[0]) if rules.table else None
        self.define = re.compile(rules.definition) if rules.definition else None
        self.comment = re.compile(rules.comments) if rules.comments else None
        self.meta = re.compile(rules.meta) if rules.meta else None

    # -- inline --------------------------------------------------------
    def inline(self, text: str, depth: int = 0) -> list[Node]:
        out: list[Node] = []

        def put(t: str) -> None:
            if self.r.escape:
                t = re.sub(re.escape(self.r.escape) + r"([^\w\s])", r"\1", t)
            if t:
                if out and out[-1].kind == "text":
                    out[-1].props["content"] += t
                else:
                    out.append(Node("text", {"content": t}))

        def lines(t: str) -> None:
            parts = t.split("\n")
            for k, part in enumerate(parts):
                if k:
                    hard = self.r.break_mark and parts[k - 1].endswith(self.r.break_mark)
                    if hard and out and out[-1].kind == "text":
                        out[-1].props["content"] = out[-1].props["content"].removesuffix(self.r.break_mark).rstrip()
                    out.append(Node("line_break" if hard else "soft_break"))
                put(part if k == len(parts) - 1 or not self.r.break_mark.isspace() else part)

        if self.inline_re is None or depth > 40:
            lines(text)
            return out
        at = 0
        for m in self.inline_re.finditer(text):
            if m.start() < at:
                continue
            i = next(k for k in range(len(self.inline_rules)) if m.group(f"r{k}") is not None)
            kind, props = self.inline_rules[i]
            groups = {k.split("_", 1)[1]: v for k, v in m.groupdict().items() if k.startswith(f"g{i}_")}
            lines(text[at : m.start()])
            at = m.end()
            out.append(self._made(kind, dict(props), groups, depth))
        lines(text[at:])
        return [n for n in out if n.kind != "text" or n.props["content"]]

    def _made(self, kind: str, props: dict, g: dict, depth: int) -> Node:
        body = g.get("t") or ""
        if kind in ("code", "math_inline", "math_display", "raw_inline", "text"):
            key = "math:source" if kind.startswith("math") else "content"
            return Node(kind, {key: body or g.get("url") or "", **props})
        if kind == "link":
            url = props.pop("prefix", "") + (g.get("url") or body)
            node = Node("link", {"url": url, **props})
            if g.get("title"):
                node.props["title"] = g["title"]
            return node.add(*self.inline(g.get("label") or g.get("url") or body, depth + 1))
        if kind == "image":
            node = Node("image", {"url": g.get("url") or body, **props})
            if g.get("label"):
                node.props["alt"] = g["label"]
            if g.get("title"):
                node.props["title"] = g["title"]
            return node
        if kind == "footnote_ref":
            return Node(kind, {"label": body, **props})
        if kind in ("line_break", "soft_break"):
            return Node(kind)
        nested = props.pop("inner", None)
        if nested:
            return Node(kind, props).add(Node(nested).add(*self.inline(body, depth + 1)))
        return Node(kind, props).add(*self.inline(body, depth + 1))

    # -- blocks ---------------------------------------------------------
    def parse(self, source: str) -> Document:
        text = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
        meta: dict = {}
        if self.r.front_matter:
            text, meta = front_matter(text)
        self.levels: list[str] = []
        self.metadata = meta
        root = Node("document", children=self.blocks(text.split("\n")))
        return Document(root, self.metadata)

    def _starts_block(self, line: str) -> bool:
        return (
            not line.strip()
            or any(p.match(line) for p, _ in self.head)
            or any(p.match(line) for p, _, _ in self.fence)
            or any(p.match(line) for p, _ in self.item)
            or bool(self.quote and self.quote.match(line))
            or bool(self.rule and self.rule.match(line))
            or bool(self.row and self.row.match(line))
            or bool(self.define and self.define.match(line))
            or bool(self.comment and self.comment.match(line))
        )

    def blocks(self, lines: list[str], depth: int = 0) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            if self.meta and (m := self.meta.match(line)):
                self.metadata[m["key"].strip().lower()] = m["value"].strip()
                i += 1
                continue
            if self.comment and self.comment.match(line):
                i += 1
                continue
            fenced = next(((m, b, k) for a, b, k in self.fence if (m := a.match(line))), None)
            if fenced:
                m, close, kind = fenced
                g = m.groupdict()
                body, i = [], i + 1
                if g.get("one") is not None:
                    body = [g["one"]]
                else:
                    while i < len(lines) and not close.match(lines[i]):
                        body.append(lines[i])
                        i += 1
                    i += 1
                out.append(self._fenced(kind, g, body, depth))
                continue
            if self.r.indented_code and re.match(r"(?: {4}|\t)", line):
                body = []
                while i < len(lines) and (re.match(r"(?: {4}|\t)", lines[i]) or not lines[i].strip()):
                    body.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                    i += 1
                out.append(Node("code_block", {"content": "\n".join(body).rstrip("\n")}))
                continue
            if self.r.underlines and i + 1 < len(lines) and (lv := self._underlined(line, lines[i + 1])):
                out.append(Node("heading", {"level": lv}).add(*self.inline(line.strip())))
                i += 2
                continue
            heading = next(((m, lv) for p, lv in self.head if (m := p.match(line))), None)
            if heading:
                m, lv = heading
                level = lv(m) if callable(lv) else lv
                out.append(Node("heading", {"level": max(1, min(6, level))}).add(*self.inline(m["t"].strip())))
                i += 1
                continue
            if self.rule and self.rule.match(line):
                out.append(Node("horizontal_rule"))
                i += 1
                continue
            if self.quote and self.quote.match(line) and depth < 40:
                body = []
                while i < len(lines) and self.quote.match(lines[i]):
                    body.append(self.quote.sub("", lines[i], count=1))
                    i += 1
                out.append(Node("blockquote").add(*self.blocks(body, depth + 1)))
                continue
            if self.row and self.row.match(line):
                rows = []
                while i < len(lines) and self.row.match(lines[i]):
                    rows.append(lines[i])
                    i += 1
                out.append(self._table(rows))
                continue
            if any(p.match(line) for p, _ in self.item):
                i = self._list(lines, i, out)
                continue
            if self.define and self.define.match(line):
                node = Node("definition_list")
                while i < len(lines) and (m := self.define.match(lines[i])):
                    node.add(Node("definition_term").add(*self.inline(m["k"].strip())))
                    node.add(Node("definition_desc").add(Node("paragraph").add(*self.inline(m["t"].strip()))))
                    i += 1
                out.append(node)
                continue
            body = [line]
            i += 1
            while i < len(lines) and not self._starts_block(lines[i]):
                if self.r.underlines and i + 1 < len(lines) and self._underlined(lines[i], lines[i + 1], peek=True):
                    break
                body.append(lines[i])
                i += 1
            out.append(Node("paragraph").add(*self.inline("\n".join(x.strip() if not self.r.break_mark.isspace() else x.lstrip() for x in body).rstrip())))
        return out

    def _underlined(self, line: str, under: str, peek: bool = False) -> int | None:
        u = under.rstrip()
        if len(u) < 2 or len(set(u)) != 1 or u[0] not in self.r.underlines or not line.strip() or set(line.strip()) == {u[0]}:
            return None
        if not self.r.adaptive:
            return self.r.underlines.index(u[0]) + 1
        if u[0] not in self.levels:
            if peek:
                return 1
            self.levels.append(u[0])
        return min(6, self.levels.index(u[0]) + 1)

    def _fenced(self, kind: str, g: dict, body: list[str], depth: int) -> Node:
        lang = (g.get("lang") or "").strip()
        if kind == "code_block":
            return Node(kind, {"content": "\n".join(body)} | ({"language": lang} if lang else {}))
        if kind == "raw_block":
            return Node(kind, {"content": "\n".join(body), "format": lang or "html"})
        if kind == "math_display":
            return Node(kind, {"math:source": "\n".join(body)})
        if kind == "comment":
            return Node("span")
        node = Node(kind, {"classes": lang} if lang and kind == "div" else {})
        return node.add(*(self.blocks(body, depth + 1) if depth < 40 else []))

    def _table(self, rows: list[str]) -> Node:
        _, sep, mark = self.r.table
        node, header = Node("table"), None
        for k, raw in enumerate(rows):
            line = raw.strip()
            if re.fullmatch(r"[|+:\-=\s]+", line) and set(line) & set("-="):
                if len(node.children) == 1 and not mark:
                    for c in node.children[0].children:
                        c.kind = "table_header"
                continue
            row = Node("table_row")
            if mark and mark == "start":
                cells = re.findall(r"(\|\||\|)\s*([^|]*)", line)
                found = [(s == "||", t) for s, t in cells if t.strip() or s == "||"]
                if found and not found[-1][1].strip():
                    found.pop()
            elif mark and mark == "caret":
                cells = re.findall(r"([\^|])([^\^|]*)", line)
                found = [(s == "^", t) for s, t in cells][:-1] or [(s == "^", t) for s, t in cells]
            else:
                inner = line.removeprefix(sep).removesuffix(sep)
                found = []
                for t in inner.split(sep):
                    head = bool(mark) and t.lstrip().startswith(mark)
                    found.append((head, t.lstrip().removeprefix(mark).removesuffix("*") if head else t))
            for head, t in found:
                row.add(Node("table_header" if head else "table_cell").add(*self.inline(t.strip())))
            node.add(row)
            del header
            header = None
        return node

    def _list(self, lines: list[str], i: int, out: list[Node]) -> int:
        stack: list[tuple[int, Node]] = []
        while i < len(lines):
            line = lines[i]
            found = next(((m, o) for p, o in self.item if (m := p.match(line))), None)
            if found:
                m, o = found
                marker = m["m"]
                depth = len(marker) if self.r.depth == "marker" else len(line) - len(line.lstrip())
                ordered = (marker[-1] in "#" or marker[-1].isdigit()) if o is None else o
                while stack and depth < stack[-1][0]:
                    stack.pop()
                if not stack or depth > stack[-1][0]:
                    made = Node("list", {"ordered": ordered})
                    num = re.search(r"\d+", marker)
                    if ordered and num and int(num.group()) != 1:
                        made.props["start"] = int(num.group())
                    if stack:
                        stack[-1][1].children[-1].add(made)
                    else:
                        out.append(made)
                    stack.append((depth, made))
                elif stack[-1][1].props["ordered"] != ordered and len(stack) == 1:
                    made = Node("list", {"ordered": ordered})
                    out.append(made)
                    stack = [(depth, made)]
                item = Node("list_item")
                body = m["t"]
                task = re.match(r"\[([ xX])\]\s+", body)
                if task:
                    item.props["checked"] = task[1] != " "
                    body = body[task.end() :]
                i += 1
                more = [body]
                while i < len(lines) and lines[i].strip() and not self._starts_block(lines[i]):
                    more.append(lines[i].strip())
                    i += 1
                item.add(Node("paragraph").add(*self.inline("\n".join(more).strip())))
                stack[-1][1].add(item)
            elif not line.strip() and i + 1 < len(lines) and any(p.match(lines[i + 1]) for p, _ in self.item):
                i += 1
            else:
                break
        return i


def front_matter(text: str) -> tuple[str, dict]:
    """Body and flattened metadata of a YAML (``---``) head; nulls and empty lists are dropped."""
    m = re.match(r"---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return text, {}
    try:
        import yaml

        data = yaml.safe_load(m[1])
    except Exception:
        return text[m.end() :], {}
    out: dict = {}

    def flat(prefix: str, v) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                flat(f"{prefix}.{k}" if prefix else str(k), x)
        elif v is None or v == []:
            return
        else:
            out[prefix] = v if isinstance(v, (str, int, float, bool, list)) else str(v)

    if isinstance(data, dict):
        flat("", data)
    return text[m.end() :], out
