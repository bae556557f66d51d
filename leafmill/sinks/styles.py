"""Text formats described by templates.

A style has a template per inline kind and a function or template per block
kind.  Marked-up XML and HTML formats use the same machinery with tags.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..model import Document, Node

Escape = Callable[[str], str]


def xml_escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def attr_escape(s: str) -> str:
    return xml_escape(s).replace('"', "&quot;")


def _same(s: str) -> str:
    return s


def backslash(chars: str) -> Escape:
    def run(s: str) -> str:
        return "".join("\\" + c if c in chars else c for c in s)

    return run


def latex_escape(s: str) -> str:
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    return "".join(special.get(c) or ("\\" + c if c in "#$%&_{}" else c) for c in s)


def rtf_escape(s: str) -> str:
    out = []
    for c in s:
        if c in "\\{}":
            out.append("\\" + c)
        elif ord(c) > 127:
            out.append("".join(f"\\u{u - 65536 if u > 32767 else u}?" for u in _utf16(c)))
        else:
            out.append(c)
    return "".join(out)


def _utf16(c: str) -> list[int]:
    raw = c.encode("utf-16-le")
    return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


@dataclass
class Style:
    escape: Escape = _same
    #: kind -> template with {t}
    inline: dict[str, str] = field(default_factory=dict)
    code: str = "{t}"
    link: str = "{t} ({url})"
    image: str = "[Image: {alt}]"
    math: tuple[str, str] = ("{t}", "{t}")
    note: str = "[{t}]"
    hard: str = "\n"
    #: level -> template
    heading: Callable[[int, str], str] = lambda n, t: t
    block: dict[str, str] = field(default_factory=dict)
    code_block: str = "{t}"
    code_indent: str = ""
    code_escape: Escape | None = None
    #: (bullet marker, ordered marker) as functions of depth and number; nested lists are indented by ``indent``.
    bullet: Callable[[int, int], str] = lambda d, n: "- "
    number: Callable[[int, int], str] = lambda d, n: f"{n}. "
    indent: str = "  "
    #: (open, item, close) templates for tagged lists
    tagged: tuple | None = None
    quote: str = "> "
    rule: str = "-----"
    #: table: function of rows of (is_header, text)
    table: Callable[[list[list[tuple[bool, str]]]], str] | None = None
    definition: str = "{k}: {t}"
    raw: tuple[str, ...] = ()
    around: str = "{t}"
    gap: str = "\n\n"


def _pipes(rows) -> str:
    out = []
    for k, r in enumerate(rows):
        out.append("| " + " | ".join(t.replace("\n", " ").replace("|", "\\|") for _, t in r) + " |")
        if k == 0:
            out.append("| " + " | ".join("---" for _ in r) + " |")
    return "\n".join(out)


def _wiki(head: str, cell: str, end: str = ""):
    def run(rows) -> str:
        return "\n".join("".join((head if h else cell) + t.replace("\n", " ") for h, t in r) + end for r in rows)

    return run


def _xml_table(table: str, row: str, head: str, cell: str, wrap: str = "{t}"):
    def run(rows) -> str:
        body = "\n".join(f"<{row}>" + "".join(f"<{head if h else cell}>{t}</{head if h else cell}>" for h, t in r) + f"</{row}>" for r in rows)
        return f"<{table}>\n" + wrap.replace("{t}", body) + f"\n</{table}>"

    return run


def _plain_table(rows) -> str:
    """Cells padded to the widest of their column, in bytes."""
    n = max((len(r) for r in rows), default=0)
    width = [max((len(r[k][1].encode()) for r in rows if k < len(r)), default=0) for k in range(n)]
    return "\n".join(" | ".join(t + " " * (width[k] - len(t.encode())) for k, (_, t) in enumerate(r)).rstrip() for r in rows)


class Emitter:
    def __init__(self, style: Style):
        self.s = style

    def inlines(self, nodes: list[Node]) -> str:
        return "".join(self.inline(n) for n in nodes)

    def inline(self, n: Node) -> str:
        s, k = self.s, n.kind
        body = lambda: self.inlines(n.children)
        if k == "text":
            return s.escape(str(n.props.get("content", "")))
        if k == "code":
            return s.code.replace("{t}", (s.code_escape or s.escape)(str(n.props.get("content", ""))))
        if k == "link":
            url = str(n.props.get("url", ""))
            return s.link.replace("{t}", body() or s.escape(url)).replace("{url}", url)
        if k == "image":
            alt = str(n.props.get("alt", "")) or n.text()
            return s.image.replace("{alt}", alt).replace("{url}", str(n.props.get("url", "")))
        if k == "line_break":
            return s.hard
        if k == "soft_break":
            return "\n"
        if k in ("math_inline", "math_display"):
            return s.math[k == "math_display"].replace("{t}", str(n.props.get("math:source", "")))
        if k == "footnote_ref":
            return s.note.replace("{t}", str(n.props.get("label", "")))
        if k in ("raw_inline", "raw_block"):
            return str(n.props.get("content", "")) if n.props.get("format") in s.raw else ""
        if k in s.inline:
            return s.inline[k].replace("{t}", body())
        if n.children or not isinstance(n.props.get("content"), str):
            return body()
        return s.escape(n.props["content"])

    BLOCKS = frozenset(
        "document paragraph heading code_block blockquote list list_item table figure horizontal_rule div raw_block definition_list caption sheet bibliography "
        "bibliography_entry footnote_def math_display table_row".split()
    )

    def blocks(self, nodes: list[Node], depth: int = 0) -> list[str]:
        out, run = [], []

        def flush() -> None:
            if run:
                t = self.inlines(run)
                if t.strip():
                    out.append(self.s.block.get("paragraph", "{t}").replace("{t}", t))
                run.clear()

        for n in nodes:
            if n.kind in self.BLOCKS:
                flush()
                t = self.one(n, depth)
                if t is not None and t != "":
                    out.append(t)
            else:
                run.append(n)
        flush()
        return out

    def one(self, n: Node, depth: int) -> str | None:
        s, k = self.s, n.kind
        if k == "paragraph":
            t = self.inlines(n.children)
            return s.block.get("paragraph", "{t}").replace("{t}", t) if t else None
        if k == "heading":
            return s.heading(n.props.get("level", 1) if isinstance(n.props.get("level"), int) else 1, self.inlines(n.children))
        if k == "code_block":
            t = (s.code_escape or _same)(str(n.props.get("content", "")).rstrip("\n"))
            if s.code_indent:
                t = "\n".join(s.code_indent + x for x in t.split("\n"))
            lang, shape = str(n.props.get("language", "")), s.code_block
            if not lang:
                for empty in ("={lang}", "({lang})", "(lang={lang})", ":{lang}", ' lang="{lang}"', ' language="{lang}"', ",{lang}", " {lang}"):
                    shape = shape.replace(empty, "()" if empty.startswith("(lang") else "")
            return shape.replace("{lang}", lang).replace("{t}", t)
        if k == "blockquote":
            inner = s.gap.join(self.blocks(n.children, depth))
            if "{t}" in s.quote:
                return s.quote.replace("{t}", inner)
            return "\n".join((s.quote + x).rstrip() for x in inner.split("\n"))
        if k == "list":
            return self.list(n, depth)
        if k == "horizontal_rule":
            return s.rule
        if k == "table":
            rows = [[(c.kind == "table_header", self.cell(c)) for c in r.children] for r in n.walk() if r.kind == "table_row"]
            return (s.table or _plain_table)(rows) if rows else None
        if k == "definition_list":
            out, term = [], ""
            for c in n.children:
                if c.kind == "definition_term":
                    term = self.inlines(c.children)
                else:
                    out.append(s.definition.replace("{k}", term).replace("{t}", " ".join(self.blocks(c.children, depth))))
            t = "\n".join(out)
            return s.block.get("definition_list", "{t}").replace("{t}", t)
        if k in ("raw_block",):
            return self.inline(n) or None
        if k == "math_display":
            return self.inline(n)
        if k == "footnote_def":
            body = " ".join(self.blocks(n.children, depth))
            return s.note.replace("{t}", str(n.props.get("label", ""))) + " " + body
        if k in ("bibliography_entry",):
            fields = [str(c.props.get("content", "")) for c in n.children if c.kind == "bibliography_field"]
            return s.escape(". ".join(f for f in fields if f)) or s.gap.join(self.blocks(n.children, depth)) or None
        inner = s.gap.join(self.blocks(n.children, depth))
        return s.block.get(k, "{t}").replace("{t}", inner) if inner else None

    def cell(self, c: Node) -> str:
        return " ".join(self.blocks(c.children)) if any(x.kind in self.BLOCKS for x in c.children) else self.inlines(c.children)

    def list(self, n: Node, depth: int) -> str:
        s, ordered = self.s, bool(n.props.get("ordered"))
        out = []
        first = n.props.get("start", 1) if isinstance(n.props.get("start", 1), int) else 1
        for i, item in enumerate(n.children):
            if s.tagged:
                body = self.tight(item, depth)
                out.append(s.tagged[2].replace("{t}", body))
                continue
            marker = (s.number if ordered else s.bullet)(depth, first + i)
            own = [c for c in item.children if c.kind != "list"]
            text = "\n".join(self.blocks(own, depth + 1)) if any(c.kind in self.BLOCKS for c in own) else self.inlines(own)
            if s.indent:
                pad = s.indent * depth
                lines = text.split("\n")
                out.append(pad + marker + ("\n" + pad + " " * len(marker)).join(lines))
            else:
                out.append(marker + text.replace("\n", " "))
            out += [self.list(c, depth + 1) for c in item.children if c.kind == "list"]
        body = "\n".join(out)
        if s.tagged:
            return s.tagged[1 if ordered else 0].replace("{t}", body)
        return body

    def tight(self, item: Node, depth: int) -> str:
        """Items of one paragraph are written without its wrapping."""
        if item.children and item.children[0].kind == "paragraph":
            rest = self.blocks(item.children[1:], depth + 1)
            return self.inlines(item.children[0].children) + ("\n" + "\n".join(rest) if rest else "")
        return "\n".join(self.blocks(item.children, depth + 1))


def emit(style: Style, doc: Document) -> str:
    body = style.gap.join(Emitter(style).blocks(doc.root.children)).strip("\n")
    title = style.escape(str(doc.metadata.get("title", "")))
    return style.around.replace("{title}", title).replace("{t}", body) + "\n"


def _tags(**kinds: str) -> dict[str, str]:
    return {k: f"<{v}>{{t}}</{v.split(' ')[0]}>" for k, v in kinds.items()}


HTML_INLINE = _tags(
    emphasis="em", strong="strong", strikeout="del", underline="u", subscript="sub", superscript="sup", quoted="q", span="span", small_caps="span class=\"small-caps\"", cite="cite",
)


def _html(around: str = "{t}") -> Style:
    return Style(
        escape=xml_escape, inline=HTML_INLINE, code="<code>{t}</code>", link='<a href="{url}">{t}</a>', image='<img src="{url}" alt="{alt}">', math=('<span class="math">{t}</span>', '<div class="math">{t}</div>'),
        note="<sup>{t}</sup>", hard="<br>", heading=lambda n, t: f"<h{n}>{t}</h{n}>", block={"paragraph": "<p>{t}</p>", "div": "<div>\n{t}\n</div>", "figure": "<figure>\n{t}\n</figure>", "caption": "<figcaption>{t}</figcaption>", "definition_list": "<dl>\n{t}\n</dl>"},
        code_block="<pre><code>{t}</code></pre>", code_escape=xml_escape, tagged=("<ul>\n{t}\n</ul>", "<ol>\n{t}\n</ol>", "<li>{t}</li>"), quote="<blockquote>\n{t}\n</blockquote>", rule="<hr>", table=_xml_table("table", "tr", "th", "td"),
        definition="<dt>{k}</dt>\n<dd>{t}</dd>", raw=("html",), around=around, gap="\n",
    )


def _md(**more) -> Style:
    base = dict(
        escape=backslash("*_`[]"), inline={"emphasis": "*{t}*", "strong": "**{t}**", "strikeout": "~~{t}~~", "superscript": "^{t}^", "subscript": "~{t}~", "quoted": '"{t}"', "underline": "<u>{t}</u>"}, code="`{t}`", code_escape=_same,
        link="[{t}]({url})", image="![{alt}]({url})", math=("${t}$", "$${t}$$"), note="[^{t}]", hard="  \n", heading=lambda n, t: "#" * n + " " + t, code_block="```{lang}\n{t}\n```", quote="> ", rule="---", table=_pipes,
        definition="{k}\n:   {t}", raw=("html", "markdown"), indent="    ",
    )
    return Style(**(base | more))


def _repeat(c: str):
    return lambda d, n: c * (d + 1) + " "


def _marks(**k: str) -> dict[str, str]:
    return {a: b.replace("|", "{t}") for a, b in k.items()}


STYLES: dict[str, Style] = {
    "html": _html(),
    "markdown": _md(), "commonmark": _md(), "gfm": _md(), "markdown-strict": _md(table=None, raw=("html",)), "multimarkdown": _md(), "markua": _md(),
    "plaintext": Style(code_indent="    ", indent="  "),
    "djot": _md(inline=_marks(emphasis="_|_", strong="*|*", strikeout="{-|-}", underline="{+|+}", superscript="^|^", subscript="~|~", quoted='"|"'), hard="\\\n", math=("$`{t}`", "$$`{t}`")),
    "org": Style(inline=_marks(emphasis="/|/", strong="*|*", strikeout="+|+", underline="_|_", superscript="^{|}", subscript="_{|}"), code="={t}=", link="[[{url}][{t}]]", image="[[{url}]]", math=("\\({t}\\)", "\\[{t}\\]"), note="[fn:{t}]", hard="\\\\\n", heading=lambda n, t: "*" * n + " " + t, code_block="#+BEGIN_SRC {lang}\n{t}\n#+END_SRC", quote="#+BEGIN_QUOTE\n{t}\n#+END_QUOTE", table=_pipes, definition="- {k} :: {t}", raw=("org",)),
    "rst": Style(escape=backslash("*`"), inline=_marks(emphasis="*|*", strong="**|**", superscript=":sup:`|`", subscript=":sub:`|`"), code="``{t}``", code_escape=_same, link="`{t} <{url}>`__", image=".. image:: {url}", math=(":math:`{t}`", ".. math::\n\n   {t}"), note="[{t}]_", heading=lambda n, t: t + "\n" + "=-~^\"'"[n - 1] * max(2, len(t)), code_block=".. code-block:: {lang}\n\n{t}", code_indent="   ", quote="    ", rule="----", definition="{k}\n    {t}", raw=("rst",)),
    "asciidoc": Style(inline=_marks(emphasis="_|_", strong="*|*", superscript="^|^", subscript="~|~", underline="[.underline]#|#", strikeout="[.line-through]#|#"), code="`{t}`", link="{url}[{t}]", image="image::{url}[{alt}]", math=("stem:[{t}]", "[stem]\n++++\n{t}\n++++"), note="footnote:[{t}]", hard=" +\n", heading=lambda n, t: "=" * (n + 1) + " " + t, code_block="[source,{lang}]\n----\n{t}\n----", bullet=_repeat("*"), number=_repeat("."), indent="", quote="____\n{t}\n____", rule="'''", table=lambda rows: "|===\n" + "\n".join("".join("|" + t + " " for _, t in r).rstrip() for r in rows) + "\n|===", definition="{k}:: {t}", raw=("asciidoc",)),
    "typst": Style(escape=backslash("#$*_@<`"), inline=_marks(emphasis="_|_", strong="*|*", strikeout="#strike[|]", underline="#underline[|]", superscript="#super[|]", subscript="#sub[|]", small_caps="#smallcaps[|]"), code="`{t}`", code_escape=_same, link='#link("{url}")[{t}]', image='#image("{url}")', math=("${t}$", "$ {t} $"), note="#footnote[{t}]", hard=" \\\n", heading=lambda n, t: "=" * n + " " + t, code_block="```{lang}\n{t}\n```", number=lambda d, n: "+ ", quote="#quote[\n{t}\n]", rule="#line(length: 100%)", table=lambda rows: f"#table(columns: {max(map(len, rows))},\n" + "\n".join(" ".join(f"[{t}]," for _, t in r) for r in rows) + "\n)", definition="/ {k}: {t}", raw=("typst",)),
    "textile": Style(inline=_marks(emphasis="_|_", strong="*|*", strikeout="-|-", underline="+|+", superscript="^|^", subscript="~|~", cite="??|??"), code="@{t}@", link='"{t}":{url}', image="!{url}({alt})!", note="[{t}]", heading=lambda n, t: f"h{n}. {t}", block={"paragraph": "{t}"}, code_block="bc({lang}). {t}", bullet=_repeat("*"), number=_repeat("#"), indent="", quote="bq. {t}", rule="---", table=_wiki("|_. ", "|", "|"), definition="- {k} := {t}", raw=("html", "textile")),
    "mediawiki": Style(inline=_marks(emphasis="''|''", strong="'''|'''", strikeout="<s>|</s>", underline="<u>|</u>", superscript="<sup>|</sup>", subscript="<sub>|</sub>"), code="<code>{t}</code>", link="[{url} {t}]", image="[[File:{url}|{alt}]]", math=("<math>{t}</math>", "<math>{t}</math>"), note="<ref>{t}</ref>", hard="<br/>", heading=lambda n, t: f"{'=' * n} {t} {'=' * n}", code_block='<syntaxhighlight lang="{lang}">\n{t}\n</syntaxhighlight>', bullet=_repeat("*"), number=_repeat("#"), indent="", quote="<blockquote>\n{t}\n</blockquote>", rule="----", table=lambda rows: '{| class="wikitable"\n' + "\n|-\n".join("\n".join(("! " if h else "| ") + t for h, t in r) for r in rows) + "\n|}", definition="; {k} : {t}", raw=("mediawiki", "html")),
    "creole": Style(inline=_marks(emphasis="//|//", strong="**|**"), code="{{{{{{{t}}}}}}}".replace("{{{{{{{t}}}}}}}", "{{{{t}}}}"), link="[[{url}|{t}]]", image="{{{url}|{alt}}}", hard="\\\\", heading=lambda n, t: f"{'=' * n} {t} {'=' * n}", code_block="{{{\n{t}\n}}}", bullet=_repeat("*"), number=_repeat("#"), indent="", quote="{t}", rule="----", table=_wiki("|= ", "| ", " |"), definition="; {k}\n: {t}"),
    "dokuwiki": Style(inline=_marks(emphasis="//|//", strong="**|**", strikeout="<del>|</del>", underline="__|__", superscript="<sup>|</sup>", subscript="<sub>|</sub>"), code="''{t}''", link="[[{url}|{t}]]", image="{{{url}|{alt}}}", note="(({t}))", hard="\\\\ ", heading=lambda n, t: f"{'=' * (7 - n)} {t} {'=' * (7 - n)}", code_block="<code {lang}>\n{t}\n</code>", bullet=lambda d, n: "  " * (d + 1) + "* ", number=lambda d, n: "  " * (d + 1) + "- ", indent="", quote="> ", rule="----", table=lambda rows: "\n".join("".join(("^ " if h else "| ") + t + " " for h, t in r) + ("^" if r and r[-1][0] else "|") for r in rows), raw=("html", "dokuwiki")),
    "vimwiki": Style(inline=_marks(emphasis="_|_", strong="*|*", strikeout="~~|~~", superscript="^|^", subscript=",,|,,"), code="`{t}`", link="[[{url}|{t}]]", image="{{{url}|{alt}}}", heading=lambda n, t: f"{'=' * n} {t} {'=' * n}", code_block="{{{{lang}\n{t}\n}}}", quote="> ", rule="----", table=_pipes, definition="{k}:: {t}"),
    "zimwiki": Style(inline=_marks(emphasis="//|//", strong="**|**", strikeout="~~|~~", underline="__|__", superscript="^{|}", subscript="_{|}"), code="''{t}''", link="[[{url}|{t}]]", image="{{{url}}}", heading=lambda n, t: f"{'=' * (7 - n)} {t} {'=' * (7 - n)}", code_block="'''\n{t}\n'''", bullet=lambda d, n: "\t" * d + "* ", number=lambda d, n: "\t" * d + f"{n}. ", indent="", quote="> ", rule="--------------------", table=_pipes),
    "tikiwiki": Style(inline=_marks(emphasis="''|''", strong="__|__", strikeout="--|--", underline="===|===", superscript="{SUP()}|{SUP}", subscript="{SUB()}|{SUB}"), code="-+{t}+-", link="[{url}|{t}]", image='{img src="{url}" alt="{alt}"}', hard="%%%", heading=lambda n, t: "!" * n + " " + t, code_block='{CODE(lang={lang})}\n{t}\n{CODE}', bullet=_repeat("*"), number=_repeat("#"), indent="", quote="{QUOTE()}\n{t}\n{QUOTE}", rule="----", table=lambda rows: "||" + "\n".join("|".join(t for _, t in r) for r in rows) + "||", definition=";{k}:{t}"),
    "twiki": Style(inline=_marks(emphasis="_|_", strong="*|*", strikeout="<del>|</del>", underline="<u>|</u>", superscript="<sup>|</sup>", subscript="<sub>|</sub>"), code="={t}=", link="[[{url}][{t}]]", image='<img src="{url}" alt="{alt}"/>', hard="%BR%", heading=lambda n, t: "---" + "+" * n + " " + t, code_block="<verbatim>\n{t}\n</verbatim>", bullet=lambda d, n: "   " * (d + 1) + "* ", number=lambda d, n: "   " * (d + 1) + "1. ", indent="", quote="<blockquote>\n{t}\n</blockquote>", rule="---", table=lambda rows: "\n".join("".join("| " + (f"*{t}*" if h else t) + " " for h, t in r) + "|" for r in rows), definition="   $ {k}: {t}"),
    "xwiki": Style(inline=_marks(emphasis="//|//", strong="**|**", strikeout="--|--", underline="__|__", superscript="^^|^^", subscript="~~|~~"), code="##{t}##", link="[[{t}>>{url}]]", image="[[image:{url}]]", heading=lambda n, t: f"{'=' * n} {t} {'=' * n}", code_block="{{code}}\n{t}\n{{/code}}", bullet=_repeat("*"), number=lambda d, n: "1" * (d + 1) + ". ", indent="", quote="{{quote}}\n{t}\n{{/quote}}", rule="----", table=_wiki("|=", "|"), definition="; {k}\n: {t}"),
    "jira": Style(inline=_marks(emphasis="_|_", strong="*|*", strikeout="-|-", underline="+|+", superscript="^|^", subscript="~|~"), code="{{{{t}}}}", link="[{t}|{url}]", image="!{url}!", hard="\\\\\n", heading=lambda n, t: f"h{n}. {t}", code_block="{code:{lang}}\n{t}\n{code}", bullet=_repeat("*"), number=_repeat("#"), indent="", quote="{quote}\n{t}\n{quote}", rule="----", table=lambda rows: "\n".join("".join(("||" if h else "|") + t for h, t in r) + ("||" if r and r[-1][0] else "|") for r in rows), definition="*{k}* {t}"),
    "haddock": Style(escape=backslash("\\/'`\"@<"), inline=_marks(emphasis="/|/", strong="__|__"), code="@{t}@", link="<{url} {t}>", image="<<{url} {alt}>>", heading=lambda n, t: "=" * n + " " + t, code_block="{t}", code_indent="> ", bullet=lambda d, n: "* ", quote="{t}", rule="", definition="[{k}]: {t}"),
    "bbcode": Style(inline=_marks(emphasis="[i]|[/i]", strong="[b]|[/b]", strikeout="[s]|[/s]", underline="[u]|[/u]", superscript="[sup]|[/sup]", subscript="[sub]|[/sub]"), code="[code]{t}[/code]", link="[url={url}]{t}[/url]", image="[img]{url}[/img]", heading=lambda n, t: f"[h{n}]{t}[/h{n}]", code_block="[code={lang}]\n{t}\n[/code]", tagged=("[list]\n{t}\n[/list]", "[list=1]\n{t}\n[/list]", "[*]{t}"), quote="[quote]\n{t}\n[/quote]", rule="[hr]", table=lambda rows: "[table]\n" + "\n".join("[tr]" + "".join(f"[{'th' if h else 'td'}]{t}[/{'th' if h else 'td'}]" for h, t in r) + "[/tr]" for r in rows) + "\n[/table]"),
    "muse": Style(inline=_marks(emphasis="*|*", strong="**|**", strikeout="~~|~~", underline="_|_", superscript="<sup>|</sup>", subscript="<sub>|</sub>"), code="={t}=", link="[[{url}][{t}]]", image="[[{url}]]", note="[{t}]", hard="<br>\n", heading=lambda n, t: "*" * min(n, 5) + " " + t, code_block="<example>\n{t}\n</example>", bullet=lambda d, n: " - ", number=lambda d, n: f" {n}. ", quote="<quote>\n{t}\n</quote>", rule="----", table=lambda rows: "\n".join((" || " if r and r[0][0] else " | ").join(t for _, t in r) for r in rows), definition=" {k} :: {t}"),
    "t2t": Style(inline=_marks(emphasis="//|//", strong="**|**", strikeout="--|--", underline="__|__"), code="``{t}``", link="[{t} {url}]", image="[{url}]", heading=lambda n, t: f"{'=' * min(n, 5)} {t} {'=' * min(n, 5)}", code_block="```\n{t}\n```", number=lambda d, n: "+ ", quote="\t", rule="--------------------", table=lambda rows: "\n".join(("|| " if r and r[0][0] else "| ") + " | ".join(t for _, t in r) + " |" for r in rows), definition=": {k}\n  {t}"),
    "fountain": Style(inline=_marks(emphasis="*|*", strong="**|**", underline="_|_"), link="{t}", image="[[{alt}]]", heading=lambda n, t: "#" * n + " " + t, rule="===", quote="> {t} <"),
    "pod": Style(inline=_marks(emphasis="I<|>", strong="B<|>", underline="U<|>"), escape=lambda s: s.replace("<", "E<lt>").replace(">", "E<gt>"), code="C<{t}>", link="L<{t}|{url}>", image="{alt}", heading=lambda n, t: f"=head{n} {t}", code_block="{t}", code_indent="    ", code_escape=_same, tagged=("=over 4\n\n{t}\n\n=back", "=over 4\n\n{t}\n\n=back", "=item * {t}\n"), quote="    ", rule="=for comment ---", definition="=item {k}\n\n{t}\n", around="=pod\n\n{t}\n\n=cut"),
    "man": Style(escape=lambda s: s.replace("\\", "\\e").replace("-", "\\-"), inline=_marks(emphasis="\\fI|\\fR", strong="\\fB|\\fR"), code="\\f(CW{t}\\fR", link="{t} ({url})", hard="\n.br\n", heading=lambda n, t: f".SH {t.upper()}" if n <= 2 else f".SS {t}", block={"paragraph": ".PP\n{t}"}, code_block=".nf\n{t}\n.fi", bullet=lambda d, n: ".IP \\(bu 2\n", number=lambda d, n: f".IP {n}. 4\n", indent="", quote=".TP\n{t}", rule=".PP\n* * *", definition=".TP\n{k}\n{t}", gap="\n", around=".TH \"{title}\" 1\n{t}"),
    "ms": Style(escape=lambda s: s.replace("\\", "\\e"), inline=_marks(emphasis="\\fI|\\fR", strong="\\fB|\\fR"), code="\\f(CW{t}\\fR", hard="\n.br\n", heading=lambda n, t: f".NH {n}\n{t}", block={"paragraph": ".LP\n{t}"}, code_block=".DS I\n{t}\n.DE", bullet=lambda d, n: ".IP \\(bu 2\n", number=lambda d, n: f".IP {n}. 4\n", indent="", quote=".QS\n{t}\n.QE", rule=".HLINE", gap="\n"),
    "texinfo": Style(escape=lambda s: s.replace("@", "@@").replace("{", "@{").replace("}", "@}"), inline=_marks(emphasis="@emph{|}", strong="@strong{|}", superscript="@sup{|}", subscript="@sub{|}", small_caps="@sc{|}"), code="@code{{t}}", link="@uref{{url}, {t}}", image="@image{{url}}", note="@footnote{{t}}", hard="@*\n", heading=lambda n, t: ("@chapter ", "@section ", "@subsection ", "@subsubsection ")[min(n, 4) - 1] + t, code_block="@example\n{t}\n@end example", tagged=("@itemize @bullet\n{t}\n@end itemize", "@enumerate\n{t}\n@end enumerate", "@item\n{t}"), quote="@quotation\n{t}\n@end quotation", rule="@noindent ------", definition="@item {k}\n{t}", raw=("texinfo",)),
    "latex": Style(escape=latex_escape, inline=_marks(emphasis="\\emph{|}", strong="\\textbf{|}", strikeout="\\sout{|}", underline="\\underline{|}", superscript="\\textsuperscript{|}", subscript="\\textsubscript{|}", small_caps="\\textsc{|}", quoted="``|''"), code="\\texttt{{t}}", link="\\href{{url}}{{t}}", image="\\includegraphics{{url}}", math=("${t}$", "\\[{t}\\]"), note="\\footnote{{t}}", hard="\\\\\n", heading=lambda n, t: ("\\section", "\\subsection", "\\subsubsection", "\\paragraph")[min(n, 4) - 1] + "{" + t + "}", code_block="\\begin{verbatim}\n{t}\n\\end{verbatim}", code_escape=latex_escape, tagged=("\\begin{itemize}\n{t}\n\\end{itemize}", "\\begin{enumerate}\n{t}\n\\end{enumerate}", "\\item {t}"), quote="\\begin{quote}\n{t}\n\\end{quote}", rule="\\hrule", table=lambda rows: "\\begin{tabular}{" + "l" * max(map(len, rows)) + "}\n" + "\n".join(" & ".join(t for _, t in r) + " \\\\" for r in rows) + "\n\\end{tabular}", definition="\\item[{k}] {t}", raw=("latex", "tex")),
    "context": Style(escape=latex_escape, inline=_marks(emphasis="{\\em |}", strong="{\\bf |}", small_caps="{\\sc |}", superscript="\\high{|}", subscript="\\low{|}"), code="\\type{{t}}", link="\\goto{{t}}[url({url})]", image="\\externalfigure[{url}]", math=("${t}$", "\\startformula {t} \\stopformula"), note="\\footnote{{t}}", hard="\\crlf\n", heading=lambda n, t: ("\\section", "\\subsection", "\\subsubsection", "\\subsubsubsection")[min(n, 4) - 1] + "{" + t + "}", code_block="\\starttyping\n{t}\n\\stoptyping", tagged=("\\startitemize\n{t}\n\\stopitemize", "\\startitemize[n]\n{t}\n\\stopitemize", "\\item {t}"), quote="\\startblockquote\n{t}\n\\stopblockquote", rule="\\thinrule", around="\\starttext\n{t}\n\\stoptext"),
    "docbook": Style(escape=xml_escape, inline=_marks(emphasis="<emphasis>|</emphasis>", strong='<emphasis role="strong">|</emphasis>', superscript="<superscript>|</superscript>", subscript="<subscript>|</subscript>", quoted="<quote>|</quote>"), code="<code>{t}</code>", link='<link xlink:href="{url}">{t}</link>', image='<inlinemediaobject><imageobject><imagedata fileref="{url}"/></imageobject></inlinemediaobject>', math=("<inlineequation><mathphrase>{t}</mathphrase></inlineequation>",) * 2, note='<footnoteref linkend="{t}"/>', heading=lambda n, t: f"<bridgehead renderas=\"sect{n}\">{t}</bridgehead>", block={"paragraph": "<para>{t}</para>", "definition_list": "<variablelist>{t}</variablelist>"}, code_block='<programlisting language="{lang}">{t}</programlisting>', code_escape=xml_escape, tagged=("<itemizedlist>\n{t}\n</itemizedlist>", "<orderedlist>\n{t}\n</orderedlist>", "<listitem><para>{t}</para></listitem>"), quote="<blockquote>{t}</blockquote>", rule="", table=_xml_table("informaltable", "tr", "th", "td"), definition="<varlistentry><term>{k}</term><listitem>{t}</listitem></varlistentry>", around='<article xmlns="http://docbook.org/ns/docbook" xmlns:xlink="http://www.w3.org/1999/xlink" version="5.0">\n<title>{title}</title>\n{t}\n</article>', gap="\n"),
    "jats": Style(escape=xml_escape, inline=_marks(emphasis="<italic>|</italic>", strong="<bold>|</bold>", strikeout="<strike>|</strike>", underline="<underline>|</underline>", superscript="<sup>|</sup>", subscript="<sub>|</sub>", small_caps="<sc>|</sc>"), code="<monospace>{t}</monospace>", link='<ext-link xlink:href="{url}">{t}</ext-link>', image='<inline-graphic xlink:href="{url}"/>', math=("<inline-formula><tex-math>{t}</tex-math></inline-formula>", "<disp-formula><tex-math>{t}</tex-math></disp-formula>"), note='<xref rid="{t}"/>', hard="<break/>", heading=lambda n, t: f"<sec><title>{t}</title></sec>", block={"paragraph": "<p>{t}</p>", "definition_list": "<def-list>{t}</def-list>"}, code_block="<preformat>{t}</preformat>", code_escape=xml_escape, tagged=('<list list-type="bullet">\n{t}\n</list>', '<list list-type="order">\n{t}\n</list>', "<list-item><p>{t}</p></list-item>"), quote="<disp-quote>{t}</disp-quote>", rule="", table=_xml_table("table", "tr", "th", "td"), definition="<def-item><term>{k}</term><def>{t}</def></def-item>", around='<article xmlns:xlink="http://www.w3.org/1999/xlink"><body>\n{t}\n</body></article>', gap="\n"),
    "tei": Style(escape=xml_escape, inline=_marks(emphasis='<hi rend="italic">|</hi>', strong='<hi rend="bold">|</hi>', superscript='<hi rend="superscript">|</hi>', subscript='<hi rend="subscript">|</hi>', underline='<hi rend="underline">|</hi>', strikeout='<hi rend="strike">|</hi>', quoted="<q>|</q>"), code="<code>{t}</code>", link='<ref target="{url}">{t}</ref>', image='<figure><graphic url="{url}"/></figure>', math=("<formula>{t}</formula>",) * 2, note='<ptr target="#{t}"/>', hard="<lb/>", heading=lambda n, t: f"<head>{t}</head>", block={"paragraph": "<p>{t}</p>", "definition_list": "<list>{t}</list>"}, code_block="<eg>{t}</eg>", code_escape=xml_escape, tagged=("<list>\n{t}\n</list>", '<list rend="numbered">\n{t}\n</list>', "<item>{t}</item>"), quote="<quote>{t}</quote>", rule='<milestone unit="section"/>', table=_xml_table("table", "row", "cell", "cell"), definition="<label>{k}</label><item>{t}</item>", around='<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>\n{t}\n</body></text></TEI>', gap="\n"),
    "fb2": Style(escape=xml_escape, inline=_marks(emphasis="<emphasis>|</emphasis>", strong="<strong>|</strong>", strikeout="<strikethrough>|</strikethrough>", superscript="<sup>|</sup>", subscript="<sub>|</sub>"), code="<code>{t}</code>", link='<a l:href="{url}">{t}</a>', image='<image l:href="{url}"/>', heading=lambda n, t: f"<title><p>{t}</p></title>" if n == 1 else f"<subtitle>{t}</subtitle>", block={"paragraph": "<p>{t}</p>"}, code_block="<p><code>{t}</code></p>", code_escape=xml_escape, tagged=("{t}", "{t}", "<p>{t}</p>"), quote="<cite>{t}</cite>", rule="<empty-line/>", table=_xml_table("table", "tr", "th", "td"), around='<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><book-title>{title}</book-title></title-info></description><body><section>\n{t}\n</section></body></FictionBook>', gap="\n"),
    "icml": Style(escape=xml_escape, code="<CharacterStyleRange AppliedCharacterStyle=\"CharacterStyle/Code\"><Content>{t}</Content></CharacterStyleRange>", inline=_marks(emphasis="|", strong="|"), heading=lambda n, t: f'<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/Header{n}"><Content>{t}</Content><Br/></ParagraphStyleRange>', block={"paragraph": '<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/Paragraph"><Content>{t}</Content><Br/></ParagraphStyleRange>'}, link="{t}", code_block='<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/CodeBlock"><Content>{t}</Content><Br/></ParagraphStyleRange>', code_escape=xml_escape, tagged=("{t}", "{t}", '<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/ListItem"><Content>{t}</Content><Br/></ParagraphStyleRange>'), quote="{t}", rule="", around='<?xml version="1.0" encoding="UTF-8"?>\n<Document><Story>\n{t}\n</Story></Document>', gap="\n"),
    "rtf": Style(escape=rtf_escape, inline=_marks(emphasis="{\\i |}", strong="{\\b |}", strikeout="{\\strike |}", underline="{\\ul |}", superscript="{\\super |}", subscript="{\\sub |}", small_caps="{\\scaps |}", all_caps="{\\caps |}", hidden="{\\v |}"), code="{\\f1 {t}}", link='{\\field{\\*\\fldinst HYPERLINK "{url}"}{\\fldrslt {t}}}', hard="\\line ", heading=lambda n, t: f"{{\\pard\\outlinelevel{n - 1} {{\\b {t}}}\\par}}", block={"paragraph": "{\\pard {t}\\par}"}, code_block="{\\pard\\f1 {t}\\par}", code_escape=lambda s: rtf_escape(s).replace("\n", "\\line "), tagged=("{t}", "{t}", "{\\pard \\bullet\\tab {t}\\par}"), quote="{\\li720 {t}}", rule="{\\pard\\brdrb\\brdrs\\par}", around="{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Times;}{\\f1 Courier;}}\n{t}\n}", gap="\n"),
    "ansi": Style(inline=_marks(emphasis="\x1b[3m|\x1b[23m", strong="\x1b[1m|\x1b[22m", strikeout="\x1b[9m|\x1b[29m", underline="\x1b[4m|\x1b[24m", hidden="\x1b[8m|\x1b[28m"), code="\x1b[36m{t}\x1b[39m", link="\x1b]8;;{url}\x1b\\{t}\x1b]8;;\x1b\\", heading=lambda n, t: f"\x1b[1m{'#' * n} {t}\x1b[0m", code_block="```{lang}\n{t}\n```", bullet=lambda d, n: "• ", quote="│ ", rule="─" * 40),
}
