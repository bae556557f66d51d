"""Descriptions of the line-oriented formats, and readers for them."""

from __future__ import annotations

import re

from .markup import Markup, Parser

# Building blocks shared by descriptions.
CODE = (r"(?P<fence>`+)(?P<t>.+?)(?P=fence)", "code", {})


def _wrapped(mark: str, kind: str, props: dict | None = None) -> tuple:
    """Text between two equal marks, not touching spaces."""
    m = re.escape(mark)
    return (rf"(?<![\w{m[-1:]}]){m}(?=\S)(?P<t>.+?)(?<=\S){m}(?!\w)", kind, props or {})


def _pair(a: str, b: str, kind: str, props: dict | None = None) -> tuple:
    return (rf"{re.escape(a)}(?P<t>.+?){re.escape(b)}", kind, props or {})


HASHES = (r"(?P<h>#{1,6})[ \t]+(?P<t>.*?)(?:[ \t]+#+)?[ \t]*$", lambda m: len(m["h"]))
FENCES = [
    (r"[ ]{0,3}```+[ ]*(?P<lang>[^`\s]*)[^`]*$", r"[ ]{0,3}```+[ ]*$", "code_block"),
    (r"[ ]{0,3}~~~+[ ]*(?P<lang>\S*).*$", r"[ ]{0,3}~~~+[ ]*$", "code_block"),
]
MD_ITEMS = [(r"[ \t]*(?P<m>[-*+])[ \t]+(?P<t>.*)$", False), (r"[ \t]*(?P<m>\d{1,9}[.)])[ \t]+(?P<t>.*)$", True)]
MD_LINKS = [
    (r"!\[(?P<label>[^\]]*)\]\((?P<url>[^)\s]+)(?:\s+\"(?P<title>[^\"]*)\")?\)", "image", {}),
    (r"(?<!!)\[(?P<label>[^\]]+)\]\((?P<url>[^)\s]*)(?:\s+\"(?P<title>[^\"]*)\")?\)", "link", {}),
    (r"<(?P<url>[a-zA-Z][\w+.-]*:[^>\s]+)>", "link", {}),
]
MD_MARKS = [
    (r"\*\*(?=\S)(?P<t>.+?)(?<=\S)\*\*", "strong", {}),
    (r"(?<!\w)__(?=\S)(?P<t>.+?)(?<=\S)__(?!\w)", "strong", {}),
    (r"\*(?=[^\s*])(?P<t>.+?)(?<=[^\s*])\*(?!\*)", "emphasis", {}),
    (r"(?<!\w)_(?=\S)(?P<t>.+?)(?<=\S)_(?!\w)", "emphasis", {}),
]
MD_RULE = r"[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
MATH = [(r"\$\$(?P<t>.+?)\$\$", "math_display", {}), (r"(?<![\\$\w])\$(?=\S)(?P<t>[^$\n]+?)(?<=\S)\$(?!\d)", "math_inline", {})]
STRIKE = (r"~~(?=\S)(?P<t>.+?)(?<=\S)~~", "strikeout", {})
NOTE = (r"\[\^(?P<t>[^\]\s]+)\]", "footnote_ref", {})
RAW_HTML = (r"(?P<t></?[a-zA-Z][^<>]*>|<!--.*?-->)", "raw_inline", {"format": "html"})
HTML_BLOCK = (r"[ ]{0,3}(?P<one></?(?:div|table|p|section|details|iframe|pre)\b.*)$", r"$^", "raw_block")
PIPES = (r"\s*\|.*\|?\s*$", "|", "")


def _markdown(name: str, extra: list, table: bool, **more) -> Markup:
    return Markup(
        name,
        headings=[HASHES],
        underlines="=-",
        fences=FENCES,
        items=MD_ITEMS,
        quote=r"[ ]{0,3}>[ ]?",
        rule=MD_RULE,
        table=PIPES if table else None,
        inlines=[CODE, *MD_LINKS, *extra, *MD_MARKS],
        escape="\\",
        indented_code=True,
        break_mark="  ",
        **more,
    )


def _equals(most: int = 6) -> tuple:
    return (rf"(?P<h>={{1,{most}}})[ ]*(?P<t>.*?)[ ]*=*[ ]*$", lambda m: len(m["h"]))


STAR_ITEMS = [(r"\s*(?P<m>\*+)[ ]+(?P<t>.*)$", False), (r"\s*(?P<m>#+)[ ]+(?P<t>.*)$", True)]
BRACKETS = [
    (r"\[\[(?P<url>[^\]|]+)\|(?P<label>[^\]]+)\]\]", "link", {}),
    (r"\[\[(?P<url>[^\]|]+)\]\]", "link", {}),
]
BRACES_IMAGE = [(r"\{\{(?P<url>[^}|]+)(?:\|(?P<label>[^}]*))?\}\}", "image", {})]

MARKUPS: dict[str, Markup] = {
    "commonmark": _markdown("commonmark", [RAW_HTML], False, front_matter=True),
    "markdown": _markdown("markdown", [*MATH, STRIKE, NOTE, RAW_HTML], True, front_matter=True, definition=""),
    "markdown-strict": _markdown("markdown-strict", [RAW_HTML], False),
    "gfm": _markdown("gfm", [STRIKE, NOTE, RAW_HTML, (r"(?<![\w/])(?P<url>https?://[^\s<>]+[\w/])", "link", {})], True),
    "multimarkdown": _markdown("multimarkdown", [*MATH, STRIKE, NOTE, RAW_HTML], True, meta=""),
    "markua": _markdown("markua", [*MATH, STRIKE, NOTE], True, comments=r"%%"),
    "djot": Markup(
        "djot", headings=[HASHES], fences=[*FENCES, (r":::+[ ]*(?P<lang>\S*)", r":::+\s*$", "div")], items=MD_ITEMS, quote=r">[ ]?", rule=MD_RULE,
        table=PIPES, escape="\\", break_mark="\\",
        inlines=[(r"\$\$`(?P<t>[^`]+)`", "math_display", {}), (r"\$`(?P<t>[^`]+)`", "math_inline", {}), CODE, *MD_LINKS, NOTE, _pair("{+", "+}", "underline"),
                 _pair("{-", "-}", "strikeout"), _pair("{=", "=}", "span"), _wrapped("*", "strong"), _wrapped("_", "emphasis"), _wrapped("^", "superscript"), _wrapped("~", "subscript")],
    ),
    "org": Markup(
        "org", headings=[(r"(?P<h>\*+)[ ]+(?:(?:TODO|DONE)[ ]+)?(?P<t>.*?)(?:[ ]+:[\w:@]+:)?[ ]*$", lambda m: len(m["h"]))],
        fences=[(r"(?i)\s*#\+begin_(?:src|example)(?:[ ]+(?P<lang>\S+))?.*$", r"(?i)\s*#\+end_(?:src|example)", "code_block"),
                (r"(?i)\s*#\+begin_quote.*$", r"(?i)\s*#\+end_quote", "blockquote"), (r"(?i)\s*#\+begin_export[ ]+(?P<lang>\S+).*$", r"(?i)\s*#\+end_export", "raw_block")],
        items=[(r"[ \t]*(?P<m>[-+])[ ]+(?P<t>.*)$", False), (r"[ \t]*(?P<m>\d+[.)])[ ]+(?P<t>.*)$", True)], rule=r"\s*-{5,}\s*$", table=(r"\s*\|.*$", "|", ""),
        meta=r"(?i)#\+(?P<key>title|author|date|language|description|keywords):(?P<value>.*)$", comments=r"#[ ]|#$|#\+",
        inlines=[(r"\[\[(?P<url>[^\]]+)\]\[(?P<label>[^\]]+)\]\]", "link", {}), (r"\[\[(?P<url>[^\]]+)\]\]", "link", {}), (r"\[fn:(?P<t>[^\]:]+)\]", "footnote_ref", {}),
                 (r"\\\((?P<t>.+?)\\\)", "math_inline", {}), _wrapped("*", "strong"), _wrapped("/", "emphasis"), _wrapped("_", "underline"), _wrapped("+", "strikeout"), _wrapped("=", "code"), _wrapped("~", "code")],
    ),
    "rst": Markup(
        "rst", underlines="=-~^\"'+*#`:.", adaptive=True, items=[(r"[ \t]*(?P<m>[-*+•])[ ]+(?P<t>.*)$", False), (r"[ \t]*(?P<m>(?:\d+|#)[.)])[ ]+(?P<t>.*)$", True)],
        fences=[(r"\.\. (?:code-block|code|sourcecode)::[ ]*(?P<lang>\S*)", r"(?=\S)", "code_block"), (r"\.\. math::", r"(?=\S)", "math_display"), (r"\.\. raw::[ ]*(?P<lang>\S+)", r"(?=\S)", "raw_block"),
                (r"\.\. (?P<lang>note|warning|tip|hint|important|caution|danger|attention|error)::.*$", r"(?=\S)", "div")],
        comments=r"\.\. (?!\[|_|image|figure)", meta=r":(?P<key>[A-Za-z][\w ]*):[ ]+(?P<value>.*)$", escape="\\", rule=r"(?:-{4,}|={4,}|\*{4,})\s*$",
        inlines=[(r"``(?P<t>.+?)``", "code", {}), (r"`(?P<label>[^`<]+?)\s*<(?P<url>[^>]+)>`__?", "link", {}), (r":math:`(?P<t>[^`]+)`", "math_inline", {}), (r":(?:sub|subscript):`(?P<t>[^`]+)`", "subscript", {}),
                 (r":(?:sup|superscript):`(?P<t>[^`]+)`", "superscript", {}), (r"\[(?P<t>#?\w+)\]_", "footnote_ref", {}), (r"\*\*(?P<t>.+?)\*\*", "strong", {}), (r"\*(?P<t>[^*]+)\*", "emphasis", {})],
    ),
    "asciidoc": Markup(
        "asciidoc", headings=[_equals()], fences=[(r"-{4,}\s*$", r"-{4,}\s*$", "code_block"), (r"\.{4,}\s*$", r"\.{4,}\s*$", "code_block"), (r"_{4,}\s*$", r"_{4,}\s*$", "blockquote"), (r"\+{4,}\s*$", r"\+{4,}\s*$", "raw_block"), (r"={4,}\s*$", r"={4,}\s*$", "div")],
        items=[(r"\s*(?P<m>\*+|-)[ ]+(?P<t>.*)$", False), (r"\s*(?P<m>\.+)[ ]+(?P<t>.*)$", True)], depth="marker", rule=r"'{3,}\s*$", comments=r"//|\[[^\]]*\]$|:\w[\w-]*:$",
        meta=r":(?P<key>[\w-]+):[ ]+(?P<value>.*)$", definition=r"(?P<k>[^:\n]+)::[ ]+(?P<t>.*)$", table=(r"\|(?!===).*$", "|", ""),
        inlines=[(r"(?P<url>https?://[^\s\[]+)\[(?P<label>[^\]]*)\]", "link", {}), (r"link:(?P<url>[^\[\s]+)\[(?P<label>[^\]]*)\]", "link", {}), (r"image:{1,2}(?P<url>[^\[\s]+)\[(?P<label>[^\]]*)\]", "image", {}), (r"stem:\[(?P<t>[^\]]+)\]", "math_inline", {}),
                 (r"footnote:\[(?P<t>[^\]]+)\]", "footnote_ref", {}), _wrapped("`", "code"), _wrapped("*", "strong"), _wrapped("_", "emphasis"), _wrapped("#", "span"), _pair("^", "^", "superscript"), _pair("~", "~", "subscript")], break_mark=" +",
    ),
    "typst": Markup(
        "typst", headings=[(r"(?P<h>=+)[ ]+(?P<t>.*)$", lambda m: len(m["h"]))], fences=[FENCES[0]], items=[(r"[ ]*(?P<m>-)[ ]+(?P<t>.*)$", False), (r"[ ]*(?P<m>\+|\d+\.)[ ]+(?P<t>.*)$", True)], comments=r"//|#(?:set|show|import|let)\b",
        definition=r"/[ ]+(?P<k>[^:]+):[ ]*(?P<t>.*)$", escape="\\", break_mark="\\",
        inlines=[(r"\$[ ](?P<t>[^$]+)[ ]\$", "math_display", {}), (r"\$(?P<t>[^$\n]+)\$", "math_inline", {}), CODE, (r"#link\(\"(?P<url>[^\"]+)\"\)\[(?P<label>[^\]]*)\]", "link", {}), (r"#image\(\"(?P<url>[^\"]+)\"[^)]*\)", "image", {}),
                 (r"#(?:emph)\[(?P<t>[^\]]*)\]", "emphasis", {}), (r"#strong\[(?P<t>[^\]]*)\]", "strong", {}), (r"#underline\[(?P<t>[^\]]*)\]", "underline", {}), (r"#strike\[(?P<t>[^\]]*)\]", "strikeout", {}), (r"#sub\[(?P<t>[^\]]*)\]", "subscript", {}),
                 (r"#super\[(?P<t>[^\]]*)\]", "superscript", {}), (r"#smallcaps\[(?P<t>[^\]]*)\]", "small_caps", {}), _wrapped("*", "strong"), _wrapped("_", "emphasis")],
    ),
    "textile": Markup(
        "textile", headings=[(r"h(?P<h>[1-6])(?:\([^)]*\))?\.[ ]+(?P<t>.*)$", lambda m: int(m["h"]))], fences=[(r"bc\.[ ](?P<one>.*)$", r"$^", "code_block"), (r"<pre>\s*$", r"</pre>", "code_block"), (r"bq\.[ ](?P<one>.*)$", r"$^", "blockquote"), (r"notextile\.[ ](?P<one>.*)$", r"$^", "raw_block")],
        items=STAR_ITEMS, depth="marker", table=(r"\|.*\|\s*$", "|", "_."),
        inlines=[(r"\"(?P<label>[^\"]+)\":(?P<url>\S+[\w/])", "link", {}), (r"!(?P<url>[^!\s(]+)(?:\((?P<label>[^)]*)\))?!", "image", {}), (r"\[(?P<t>\d+)\]", "footnote_ref", {}), _wrapped("@", "code"), _wrapped("**", "strong"), _wrapped("*", "strong"), _wrapped("__", "emphasis"), _wrapped("_", "emphasis"),
                 _wrapped("-", "strikeout"), _wrapped("+", "underline"), _wrapped("^", "superscript"), _wrapped("~", "subscript"), _pair("??", "??", "cite")],
    ),
    "mediawiki": Markup(
        "mediawiki", headings=[(r"(?P<h>={1,6})[ ]*(?P<t>.+?)[ ]*=+[ ]*$", lambda m: len(m["h"]))], fences=[(r"<(?:pre|syntaxhighlight|source)(?:[^>]*lang=\"(?P<lang>\w+)\")?[^>]*>\s*$", r".*</(?:pre|syntaxhighlight|source)>", "code_block"), (r"<blockquote>\s*$", r"</blockquote>", "blockquote")],
        items=[(r"(?P<m>[*#]*\*)[ ]*(?P<t>.*)$", False), (r"(?P<m>[*#]*#)[ ]*(?P<t>.*)$", True)], depth="marker", rule=r"-{4,}\s*$", definition=r";[ ]*(?P<k>[^:]+):[ ]*(?P<t>.*)$", comments=r"<!--.*-->\s*$|\{\||\|\}|\|-",
        inlines=[(r"<nowiki>(?P<t>.*?)</nowiki>", "text", {}), (r"<code>(?P<t>.*?)</code>", "code", {}), (r"<math>(?P<t>.*?)</math>", "math_inline", {}), (r"<ref[^>/]*>(?P<t>.*?)</ref>", "footnote_ref", {}), (r"\[\[(?:File|Image):(?P<url>[^\]|]+)(?:\|(?:[^\]|]*\|)*(?P<label>[^\]|]*))?\]\]", "image", {}), *BRACKETS,
                 (r"\[(?P<url>https?://\S+)[ ]+(?P<label>[^\]]+)\]", "link", {}), (r"<br\s*/?>", "line_break", {}), (r"'''''(?P<t>.+?)'''''", "strong", {"inner": "emphasis"}), (r"'''(?P<t>.+?)'''", "strong", {}), (r"''(?P<t>.+?)''", "emphasis", {}),
                 _pair("<s>", "</s>", "strikeout"), _pair("<del>", "</del>", "strikeout"), _pair("<u>", "</u>", "underline"), _pair("<sub>", "</sub>", "subscript"), _pair("<sup>", "</sup>", "superscript")],
    ),
    "creole": Markup(
        "creole", headings=[_equals()], fences=[(r"\{\{\{\s*$", r"\}\}\}\s*$", "code_block")], items=[(r"\s*(?P<m>\*+)(?!\*)[ ]+(?P<t>.*)$", False), (r"\s*(?P<m>#+)[ ]+(?P<t>.*)$", True)], depth="marker", rule=r"\s*-{4,}\s*$", table=(r"\s*\|.*$", "|", "="),
        inlines=[(r"\{\{\{(?P<t>.+?)\}\}\}", "code", {}), *BRACES_IMAGE, *BRACKETS, _pair("**", "**", "strong"), (r"(?<!:)//(?P<t>.+?)(?<!:)//", "emphasis", {}), (r"\\\\", "line_break", {}), (r"(?P<url>https?://[^\s|\]]+)", "link", {})],
    ),
    "dokuwiki": Markup(
        "dokuwiki", headings=[(r"\s*(?P<h>={2,6})[ ]*(?P<t>.*?)[ ]*=+\s*$", lambda m: 7 - len(m["h"]))], fences=[(r"<(?:code|file)(?:[ ]+(?P<lang>\w+))?[^>]*>\s*$", r"</(?:code|file)>", "code_block")], items=[(r"(?P<m>[ ]{2,}\*)[ ]*(?P<t>.*)$", False), (r"(?P<m>[ ]{2,}-)[ ]*(?P<t>.*)$", True)],
        quote=r">[ ]?", rule=r"-{4,}\s*$", table=(r"[|^].*[|^]\s*$", "|", "caret"), break_mark="\\\\",
        inlines=[(r"<nowiki>(?P<t>.*?)</nowiki>", "text", {}), (r"%%(?P<t>.+?)%%", "text", {}), *BRACES_IMAGE, *BRACKETS, (r"\(\((?P<t>.+?)\)\)", "footnote_ref", {}), _pair("''", "''", "code"), _pair("**", "**", "strong"), (r"(?<!:)//(?P<t>.+?)(?<!:)//", "emphasis", {}), _pair("__", "__", "underline"),
                 _pair("<del>", "</del>", "strikeout"), _pair("<sub>", "</sub>", "subscript"), _pair("<sup>", "</sup>", "superscript")],
    ),
    "vimwiki": Markup(
        "vimwiki", headings=[(r"\s*(?P<h>={1,6})[ ]+(?P<t>.*?)[ ]+=+\s*$", lambda m: len(m["h"]))], fences=[(r"\{\{\{(?P<lang>\w*).*$", r"\}\}\}", "code_block")], items=[(r"[ ]*(?P<m>[-*])[ ]+(?P<t>.*)$", False), (r"[ ]*(?P<m>#|\d+[.)])[ ]+(?P<t>.*)$", True)], rule=r"-{4,}\s*$", table=PIPES, comments=r"%%",
        definition=r"(?P<k>\w[^:]*)::[ ]+(?P<t>.*)$", meta=r"%(?P<key>title|date|template)[ ]+(?P<value>.*)$", inlines=[_wrapped("`", "code"), *BRACES_IMAGE, *BRACKETS, _wrapped("*", "strong"), _wrapped("_", "emphasis"), _pair("~~", "~~", "strikeout"), _pair("^", "^", "superscript"), _pair(",,", ",,", "subscript")],
    ),
    "zimwiki": Markup(
        "zimwiki", headings=[(r"(?P<h>={2,6})[ ]*(?P<t>.*?)[ ]*=+\s*$", lambda m: 7 - len(m["h"]))], fences=[(r"'''\s*$", r"'''\s*$", "code_block")], items=[(r"\t*(?P<m>\*)[ ]+(?P<t>.*)$", False), (r"\t*(?P<m>\d+\.)[ ]+(?P<t>.*)$", True)], rule=r"-{5,}\s*$", table=PIPES,
        inlines=[_pair("''", "''", "code"), *BRACES_IMAGE, *BRACKETS, _pair("**", "**", "strong"), (r"(?<!:)//(?P<t>.+?)(?<!:)//", "emphasis", {}), _pair("__", "__", "underline"), _pair("~~", "~~", "strikeout"), _pair("_{", "}", "subscript"), _pair("^{", "}", "superscript")],
    ),
    "tikiwiki": Markup(
        "tikiwiki", headings=[(r"(?P<h>!{1,6})[ ]*(?P<t>.*)$", lambda m: len(m["h"]))], fences=[(r"\{CODE\((?:.*?colors=\"?(?P<lang>\w+))?.*?\)\}\s*$", r"\{CODE\}", "code_block"), (r"\{QUOTE\(.*?\)\}\s*$", r"\{QUOTE\}", "blockquote")], items=[(r"(?P<m>\*+)[ ]*(?P<t>.*)$", False), (r"(?P<m>#+)[ ]*(?P<t>.*)$", True)], depth="marker", rule=r"-{4,}\s*$", table=(r"\|\|.*\|\|\s*$", "||", ""),
        inlines=[(r"~np~(?P<t>.*?)~/np~", "text", {}), (r"\{img[ ]+src=\"?(?P<url>[^\s\"}]+)\"?[^}]*\}", "image", {}), (r"\[(?P<url>[^\]|]+)\|(?P<label>[^\]]+)\]", "link", {}), (r"\(\((?P<url>[^)|]+)(?:\|(?P<label>[^)]+))?\)\)", "link", {}), _pair("__", "__", "strong"), _pair("''", "''", "emphasis"), _pair("===", "===", "underline"), _pair("--", "--", "strikeout"), _pair("-+", "+-", "code"), _pair("{SUP()}", "{SUP}", "superscript"), _pair("{SUB()}", "{SUB}", "subscript")],
    ),
    "twiki": Markup(
        "twiki", headings=[(r"---(?P<h>\+{1,6})!{0,2}[ ]*(?P<t>.*)$", lambda m: len(m["h"]))], fences=[(r"<verbatim[^>]*>\s*$", r"</verbatim>", "code_block"), (r"<blockquote>\s*$", r"</blockquote>", "blockquote")], items=[(r"(?P<m>(?:[ ]{3})+\*)[ ]+(?P<t>.*)$", False), (r"(?P<m>(?:[ ]{3})+\d+\.?)[ ]+(?P<t>.*)$", True)], rule=r"-{3,}\s*$", table=(r"\|.*\|\s*$", "|", "*"), definition=r"[ ]{3}\$[ ](?P<k>[^:]+):[ ](?P<t>.*)$",
        inlines=[(r"\[\[(?P<url>[^\]]+)\]\[(?P<label>[^\]]+)\]\]", "link", {}), (r"\[\[(?P<url>[^\]]+)\]\]", "link", {}), _wrapped("==", "strong", {"inner": "code"}), _wrapped("=", "code"), _wrapped("__", "strong", {"inner": "emphasis"}), _wrapped("*", "strong"), _wrapped("_", "emphasis"), (r"%BR%", "line_break", {}), (r"<br\s*/?>", "line_break", {}), _pair("<del>", "</del>", "strikeout"), _pair("<u>", "</u>", "underline"), _pair("<sub>", "</sub>", "subscript"), _pair("<sup>", "</sup>", "superscript")],
    ),
    "xwiki": Markup(
        "xwiki", headings=[(r"(?P<h>={1,6})[ ]*(?P<t>.*?)[ ]*=+\s*$", lambda m: len(m["h"]))], fences=[(r"\{\{code(?:[^}]*language=\"?(?P<lang>\w+)\"?)?[^}]*\}\}\s*$", r"\{\{/code\}\}", "code_block"), (r"\{\{(?P<lang>info|warning|error|success)\}\}\s*$", r"\{\{/\w+\}\}", "div")], items=[(r"(?P<m>\*+)\.?[ ]+(?P<t>.*)$", False), (r"(?P<m>1+)\.[ ]+(?P<t>.*)$", True)], depth="marker", quote=r">[ ]?", rule=r"-{4,}\s*$", table=(r"\|.*$", "|", "="),
        inlines=[(r"\{\{\{(?P<t>.*?)\}\}\}", "text", {}), (r"\[\[image:(?P<url>[^\]|]+)(?:\|\|alt=\"(?P<label>[^\"]*)\")?\]\]", "image", {}), (r"\[\[(?P<label>[^\]>]+)>>(?P<url>[^\]]+)\]\]", "link", {}), (r"\[\[(?P<url>[^\]]+)\]\]", "link", {}), _pair("**", "**", "strong"), (r"(?<!:)//(?P<t>.+?)(?<!:)//", "emphasis", {}), _pair("__", "__", "underline"), _pair("--", "--", "strikeout"), _pair("##", "##", "code"), _pair("^^", "^^", "superscript"), _pair(",,", ",,", "subscript")],
    ),
    "jira": Markup(
        "jira", headings=[(r"h(?P<h>[1-6])\.[ ]+(?P<t>.*)$", lambda m: int(m["h"]))], fences=[(r"\{code(?::(?P<lang>\w+)[^}]*)?\}\s*$", r"\{code\}", "code_block"), (r"\{noformat\}\s*$", r"\{noformat\}", "code_block"), (r"\{quote\}\s*$", r"\{quote\}", "blockquote"), (r"\{(?P<lang>panel)[^}]*\}\s*$", r"\{panel\}", "div"), (r"bq\.[ ](?P<one>.*)$", r"$^", "blockquote")], items=[(r"(?P<m>\*+)[ ]+(?P<t>.*)$", False), (r"(?P<m>#+)[ ]+(?P<t>.*)$", True), (r"(?P<m>-)[ ]+(?P<t>.*)$", False)], depth="marker", rule=r"-{4,}\s*$", table=(r"\|.*\|\s*$", "|", "start"),
        inlines=[(r"\{\{(?P<t>.+?)\}\}", "code", {}), (r"\[~(?P<t>[^\]]+)\]", "span", {}), (r"\[(?P<label>[^\]|]+)\|(?P<url>[^\]]+)\]", "link", {}), (r"\[(?P<url>https?://[^\]]+)\]", "link", {}), (r"!(?P<url>[^!\s|]+)(?:\|[^!]*)?!", "image", {}), (r"\{color:(?:[^}]+)\}(?P<t>.*?)\{color\}", "span", {}), _wrapped("*", "strong"), _wrapped("_", "emphasis"), _wrapped("+", "underline"), _wrapped("-", "strikeout"), _wrapped("^", "superscript"), _wrapped("~", "subscript")],
    ),
    "haddock": Markup(
        "haddock", headings=[(r"(?P<h>={1,6})[ ]+(?P<t>.*)$", lambda m: len(m["h"]))], fences=[(r"@\s*$", r"@\s*$", "code_block"), (r">(?P<one>.*)$", r"$^", "code_block")], items=[(r"[ ]*(?P<m>[*-])[ ]+(?P<t>.*)$", False), (r"[ ]*(?P<m>(?:\d+\.|\(\d+\)))[ ]+(?P<t>.*)$", True)], definition=r"\[(?P<k>[^\]]+)\]:?[ ]+(?P<t>.*)$",
        inlines=[(r"@(?P<t>[^@\n]+)@", "code", {}), (r"<(?P<url>https?://[^>\s]+)(?:[ ]+(?P<label>[^>]+))?>", "link", {}), (r"\[(?P<label>[^\]]+)\]\((?P<url>[^)]+)\)", "link", {}), _pair("__", "__", "strong"), (r"/(?=\S)(?P<t>[^/\n]+)/", "emphasis", {}), (r"'(?P<t>[\w.]+)'", "code", {}), (r"\"(?P<t>[A-Z][\w.]*)\"", "link", {})],
    ),
    "bbcode": Markup(
        "bbcode", headings=[(r"\[h(?P<h>[1-6])\](?P<t>.*?)\[/h[1-6]\]\s*$", lambda m: int(m["h"]))], fences=[(r"\[code(?:=(?P<lang>\w+))?\]\s*$", r".*\[/code\]", "code_block"), (r"\[code(?:=(?P<lang>\w+))?\](?P<one>.*)\[/code\]\s*$", r"$^", "code_block"), (r"\[quote[^\]]*\](?P<one>.*)\[/quote\]\s*$", r"$^", "blockquote"), (r"\[quote[^\]]*\]\s*$", r"\[/quote\]", "blockquote")],
        items=[(r"\s*(?P<m>\[\*\])[ ]*(?P<t>.*?)(?:\[/\*\])?$", False)], comments=r"\s*\[/?list[^\]]*\]\s*$", rule=r"\[hr\]\s*$",
        inlines=[_pair("[b]", "[/b]", "strong"), _pair("[i]", "[/i]", "emphasis"), _pair("[u]", "[/u]", "underline"), _pair("[s]", "[/s]", "strikeout"), _pair("[sub]", "[/sub]", "subscript"), _pair("[sup]", "[/sup]", "superscript"), (r"\[code\](?P<t>.*?)\[/code\]", "code", {}), (r"\[noparse\](?P<t>.*?)\[/noparse\]", "text", {}), (r"\[url=(?P<url>[^\]]+)\](?P<label>.*?)\[/url\]", "link", {}), (r"\[url\](?P<url>.*?)\[/url\]", "link", {}), (r"\[email\](?P<url>.*?)\[/email\]", "link", {"prefix": "mailto:"}), (r"\[img[^\]]*\](?P<url>.*?)\[/img\]", "image", {}), (r"\[(?:color|size|font)=[^\]]+\](?P<t>.*?)\[/(?:color|size|font)\]", "span", {})],
    ),
    "muse": Markup(
        "muse", headings=[(r"(?P<h>\*{1,5})[ ]+(?P<t>.*)$", lambda m: len(m["h"]))], fences=[(r"<(?:example|src)(?:[ ]+lang=\"(?P<lang>\w+)\")?[^>]*>\s*$", r"</(?:example|src)>", "code_block"), (r"\{\{\{\s*$", r"\}\}\}", "code_block"), (r"<quote>\s*$", r"</quote>", "blockquote"), (r"<(?P<lang>center|right|verse)>\s*$", r"</\w+>", "div"), (r"<literal>\s*$", r"</literal>", "raw_block")], items=[(r"[ ]+(?P<m>-)[ ]+(?P<t>.*)$", False), (r"[ ]+(?P<m>\d+\.)[ ]+(?P<t>.*)$", True)], rule=r"-{4,}\s*$", comments=r";[ ]", meta=r"#(?P<key>title|author|date|lang|subtitle|SORTtopics)[ ]+(?P<value>.*)$", definition=r"[ ]+(?P<k>\S.*?)[ ]+::[ ]+(?P<t>.*)$", table=(r".*[^|]\|[^|].*$", "|", ""),
        inlines=[(r"\[\[(?P<url>[^\]]+\.(?:png|jpg|gif|svg))\]\]", "image", {}), (r"\[\[(?P<url>[^\]]+)\]\[(?P<label>[^\]]+)\]\]", "link", {}), (r"\[\[(?P<url>[^\]]+)\]\]", "link", {}), (r"\[(?P<t>\d+)\]", "footnote_ref", {}), (r"<code>(?P<t>.*?)</code>", "code", {}), _wrapped("=", "code"), _wrapped("**", "strong"), _wrapped("*", "emphasis"), _wrapped("_", "underline"), _pair("<del>", "</del>", "strikeout"), _pair("<sup>", "</sup>", "superscript"), _pair("<sub>", "</sub>", "subscript"), (r"<br\s*/?>", "line_break", {})],
    ),
    "t2t": Markup(
        "t2t", headings=[(r"\s*(?P<h>={1,5})[ ]*(?P<t>[^=].*?)[ ]*=+(?:\[[\w-]+\])?\s*$", lambda m: len(m["h"])), (r"\s*(?P<h>\+{1,5})[ ]*(?P<t>[^+].*?)[ ]*\++\s*$", lambda m: len(m["h"]))], fences=[(r"```\s*$", r"```\s*$", "code_block"), (r"```[ ](?P<one>.*)$", r"$^", "code_block"), (r'"""\s*$', r'"""\s*$', "raw_block")], items=[(r"[ ]*(?P<m>-)[ ]+(?P<t>.*)$", False), (r"[ ]*(?P<m>\+)[ ]+(?P<t>.*)$", True)], quote=r"\t", rule=r"[-=_]{20,}\s*$", comments=r"%", table=(r"\s*\|{1,2}[ ].*$", "|", ""), definition=r":[ ]+(?P<k>[^:]+):[ ]*(?P<t>.*)$",
        inlines=[_pair("``", "``", "code"), _pair('""', '""', "text"), (r"\[(?P<url>[^\s\]]+\.(?:png|jpe?g|gif))\]", "image", {}), (r"\[(?P<label>[^\]]+?)[ ]+(?P<url>\S+)\]", "link", {}), _pair("**", "**", "strong"), (r"(?<!:)//(?P<t>.+?)(?<!:)//", "emphasis", {}), _pair("__", "__", "underline"), _pair("--", "--", "strikeout")],
    ),
    "fountain": Markup(
        "fountain", headings=[(r"(?P<t>(?:INT|EXT|EST|INT\./EXT|I/E)[. ].*)$", 2), (r"(?P<h>#{1,6})[ ]*(?P<t>.*)$", lambda m: len(m["h"]))], fences=[(r"/\*(?P<one>.*)\*/\s*$", r"$^", "comment")], rule=r"={3,}\s*$", meta=r"(?P<key>Title|Credit|Author|Authors|Source|Draft date|Contact|Copyright):[ ]*(?P<value>.*)$", comments=r"=[ ]",
        inlines=[_pair("***", "***", "strong", {"inner": "emphasis"}), _pair("**", "**", "strong"), _pair("*", "*", "emphasis"), _wrapped("_", "underline"), (r"\[\[(?P<t>.*?)\]\]", "span", {})],
    ),
    "pod": Markup(
        "pod", headings=[(r"=head(?P<h>[1-6])[ ]+(?P<t>.*)$", lambda m: int(m["h"]))], items=[(r"=item[ ]+(?P<m>\*)[ ]*(?P<t>.*)$", False), (r"=item[ ]+(?P<m>\d+\.?)[ ]*(?P<t>.*)$", True)], fences=[(r"=begin[ ]+(?P<lang>\S+)", r"=end", "raw_block")], comments=r"=(?:pod|cut|over|back|encoding|for)\b", indented_code=True,
        inlines=[(r"L<(?P<label>[^|>]+)\|(?P<url>[^>]+)>", "link", {}), (r"L<(?P<url>[^>]+)>", "link", {}), (r"C<(?:<+[ ])?(?P<t>.*?)(?:[ ]>+)?>", "code", {}), (r"B<(?P<t>[^>]*)>", "strong", {}), (r"I<(?P<t>[^>]*)>", "emphasis", {}), (r"U<(?P<t>[^>]*)>", "underline", {}), (r"F<(?P<t>[^>]*)>", "emphasis", {}), (r"E<lt>", "text", {"content": "<"}), (r"E<gt>", "text", {"content": ">"}), (r"[XZ]<[^>]*>", "soft_break", {})],
    ),
    "man": Markup(
        "man", headings=[(r"\.SH[ ]+\"?(?P<t>.*?)\"?$", 1), (r"\.SS[ ]+\"?(?P<t>.*?)\"?$", 2)], fences=[(r"\.(?:nf|EX)\b", r"\.(?:fi|EE)\b", "code_block")], items=[(r"\.IP[ ]+\"?(?P<m>\\\(bu|\*|-|o)\"?.*(?P<t>)$", False), (r"\.IP[ ]+\"?(?P<m>\d+[.)]?)\"?.*(?P<t>)$", True)], comments=r"\.\\\"|'\\\"|\.(?:PP|P|LP|br|sp|RS|RE|TP|de|ds|ad|hy)\b", meta=r"\.TH[ ]+(?P<key>)(?P<value>.*)$",
        inlines=[(r"\\fB(?P<t>.*?)\\f[RP]", "strong", {}), (r"\\fI(?P<t>.*?)\\f[RP]", "emphasis", {}), (r"\\f(?:C|CW|\(CW)(?P<t>.*?)\\f[RP]", "code", {}), (r"^\.B[ ]+(?P<t>.*)$", "strong", {}), (r"^\.I[ ]+(?P<t>.*)$", "emphasis", {})],
    ),
    "texinfo": Markup(
        "texinfo", headings=[(r"@(?:chapter|unnumbered|appendix|chapheading|top)[ ]+(?P<t>.*)$", 1), (r"@(?:section|unnumberedsec|heading|appendixsec)[ ]+(?P<t>.*)$", 2), (r"@(?:subsection|unnumberedsubsec|subheading)[ ]+(?P<t>.*)$", 3), (r"@(?:subsubsection|subsubheading)[ ]+(?P<t>.*)$", 4)],
        fences=[(r"@(?:small)?(?:example|lisp|verbatim|display|format)\b", r"@end[ ]+(?:small)?(?:example|lisp|verbatim|display|format)", "code_block"), (r"@(?:small)?quotation\b", r"@end[ ]+(?:small)?quotation", "blockquote"), (r"@(?P<lang>html|tex|docbook)\b", r"@end[ ]+\w+", "raw_block"), (r"@ignore\b", r"@end[ ]+ignore", "comment")], items=[(r"@item(?P<m>)[ ]*(?P<t>.*)$", False)], comments=r"@(?:c|comment|node|itemize|enumerate|end|table|menu|bye|setfilename|noindent|contents|include|printindex|cindex|findex)\b|\\input", meta=r"@(?P<key>settitle|title|author)[ ]+(?P<value>.*)$",
        inlines=[(r"@uref\{(?P<url>[^,}]+)(?:,[ ]*(?P<label>[^}]*))?\}", "link", {}), (r"@(?:url|email)\{(?P<url>[^}]+)\}", "link", {}), (r"@image\{(?P<url>[^,}]+)[^}]*\}", "image", {}), (r"@(?:code|samp|kbd|key|command|option|env|file|verb|t)\{(?P<t>[^}]*)\}", "code", {}), (r"@(?:strong|b)\{(?P<t>[^}]*)\}", "strong", {}), (r"@(?:emph|i|var|dfn|cite|slanted)\{(?P<t>[^}]*)\}", "emphasis", {}), (r"@sc\{(?P<t>[^}]*)\}", "small_caps", {}), (r"@sup\{(?P<t>[^}]*)\}", "superscript", {}), (r"@sub\{(?P<t>[^}]*)\}", "subscript", {}), (r"@footnote\{(?P<t>[^}]*)\}", "footnote_ref", {}), (r"@\*", "line_break", {}), (r"@(?P<t>[@{}])", "text", {})],
    ),
    "latex": Markup(
        "latex", headings=[(r"\\chapter\*?\{(?P<t>.*)\}\s*(?:\\label\{.*\})?$", 1), (r"\\section\*?\{(?P<t>.*?)\}\s*(?:\\label\{.*\})?$", 1), (r"\\subsection\*?\{(?P<t>.*?)\}\s*(?:\\label\{.*\})?$", 2), (r"\\subsubsection\*?\{(?P<t>.*?)\}\s*(?:\\label\{.*\})?$", 3), (r"\\paragraph\*?\{(?P<t>.*?)\}$", 4)],
        fences=[(r"\s*\\begin\{(?:verbatim|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{(?P<lang>\w+)\})?", r"\s*\\end\{(?:verbatim|lstlisting|minted)\}", "code_block"), (r"\s*\\begin\{(?:quote|quotation)\}", r"\s*\\end\{(?:quote|quotation)\}", "blockquote"), (r"\s*\\begin\{(?:equation|align|displaymath|gather)\*?\}", r"\s*\\end\{(?:equation|align|displaymath|gather)\*?\}", "math_display"), (r"\s*\\\[\s*$", r"\s*\\\]", "math_display")],
        items=[(r"\s*\\item(?P<m>)\s*(?P<t>.*)$", False)], comments=r"%|\s*\\(?:documentclass|usepackage|begin|end|maketitle|label|centering|newcommand|pagestyle)\b", meta=r"\\(?P<key>title|author|date)\{(?P<value>.*)\}\s*$", rule=r"\s*\\(?:hrule|rule)\b", break_mark="\\\\",
        inlines=[(r"\$\$(?P<t>.+?)\$\$", "math_display", {}), (r"(?<!\\)\$(?P<t>[^$]+)\$", "math_inline", {}), (r"\\\((?P<t>.+?)\\\)", "math_inline", {}), (r"\\href\{(?P<url>[^}]+)\}\{(?P<label>[^}]*)\}", "link", {}), (r"\\url\{(?P<url>[^}]+)\}", "link", {}), (r"\\includegraphics(?:\[[^\]]*\])?\{(?P<url>[^}]+)\}", "image", {}), (r"\\(?:textbf|bf)\{(?P<t>[^{}]*)\}", "strong", {}), (r"\\(?:emph|textit)\{(?P<t>[^{}]*)\}", "emphasis", {}), (r"\\underline\{(?P<t>[^{}]*)\}", "underline", {}), (r"\\(?:texttt|verb)\{(?P<t>[^{}]*)\}", "code", {}), (r"\\(?:sout|st)\{(?P<t>[^{}]*)\}", "strikeout", {}), (r"\\textsc\{(?P<t>[^{}]*)\}", "small_caps", {}), (r"\\textsuperscript\{(?P<t>[^{}]*)\}", "superscript", {}), (r"\\textsubscript\{(?P<t>[^{}]*)\}", "subscript", {}), (r"\\footnote\{(?P<t>[^{}]*)\}", "footnote_ref", {}), (r"\\cite[tp]?\{(?P<t>[^{}]*)\}", "cite", {})],
    ),
}

_PARSERS: dict[str, Parser] = {}


def parse(fmt: str, source: str):
    if fmt not in _PARSERS:
        _PARSERS[fmt] = Parser(MARKUPS[fmt])
    return _PARSERS[fmt].parse(source)
