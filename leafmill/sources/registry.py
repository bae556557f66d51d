"""Formats by name: readers, aliases and file extensions."""

from __future__ import annotations

from ..model import Document, Node

#: Formats read from bytes.
BINARY = frozenset(("docx", "xlsx", "pptx", "odt", "epub", "pdf"))
#: Other names of formats, and file extensions (fixed values).
ALIASES = {"md": "markdown", "cm": "commonmark", "mmd": "multimarkdown", "tex": "latex", "adoc": "asciidoc", "wiki": "mediawiki", "docbook5": "docbook", "txt": "plaintext", "htm": "html", "texi": "texinfo", "bib": "bibtex", "typ": "typst"}
EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "tex": "latex", "org": "org", "rst": "rst", "adoc": "asciidoc", "typ": "typst", "dj": "djot", "textile": "textile", "mediawiki": "mediawiki",
    "creole": "creole", "dokuwiki": "dokuwiki", "pod": "pod", "bbcode": "bbcode", "fountain": "fountain", "muse": "muse", "t2t": "t2t", "texi": "texinfo", "dbk": "docbook", "jats": "jats", "tei": "tei", "fb2": "fb2", "opml": "opml",
    "bib": "bibtex", "ris": "ris", "csv": "csv", "tsv": "tsv", "ipynb": "ipynb", "json": "pandoc-json", "native": "native", "ansi": "ansi", "txt": "plaintext", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "epub": "epub", "odt": "odt", "pptx": "pptx", "rtf": "rtf",
}


def _plain(source) -> Document:
    return Document(Node("document", children=[Node("paragraph", children=[Node("text", {"content": line})] if line else []) for line in (source or "").split("\n")]))


def readers() -> dict:
    """Reader of each format."""
    from . import containers, data, formats, html, xmlmap

    found = {"html": html.parse, "plaintext": _plain}
    found |= {f: (lambda s, f=f: formats.parse(f, s)) for f in formats.MARKUPS}
    found |= {f: (lambda s, f=f: xmlmap.parse(f, s)) for f in xmlmap.MAPS}
    found |= {
        "csv": data.csv, "tsv": data.tsv, "bibtex": data.bibtex, "biblatex": data.bibtex, "ris": data.ris, "csl-json": data.csl_json, "endnotexml": data.endnotexml,
        "ipynb": data.ipynb, "pandoc-json": data.pandoc_json, "native": data.native, "ansi": data.ansi, "rtf": data.rtf,
    }
    found |= {f: getattr(containers, f) for f in BINARY}
    return found


_READERS: dict | None = None


def detect(path: str) -> str | None:
    """Format by file extension."""
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def parse(fmt: str, source) -> Document:
    """Parse a text or bytes in ``fmt``; null is empty."""
    global _READERS
    if _READERS is None:
        _READERS = readers()
    fmt = fmt.lower()
    fmt = ALIASES.get(fmt, fmt)
    reader = _READERS.get(fmt)
    if reader is None:
        raise ValueError(f"unsupported format: {fmt}")
    if fmt not in BINARY and isinstance(source, (bytes, bytearray)) and fmt != "rtf":
        source = bytes(source).decode("utf-8")
    d = reader(("" if fmt not in BINARY else b"") if source is None else source)
    d.source = fmt
    return d


def categorize(error: Exception) -> str:
    """Category of a parse error."""
    import json
    import zipfile
    from xml.etree.ElementTree import ParseError

    if isinstance(error, zipfile.BadZipFile):
        return "zip_corruption"
    if isinstance(error, ParseError):
        return "xml_malformed"
    if isinstance(error, UnicodeError):
        return "xml_encoding"
    if isinstance(error, (KeyError, StopIteration)):
        return "missing_required_part"
    if isinstance(error, NotImplementedError):
        return "zip_unsupported_compression"
    if isinstance(error, json.JSONDecodeError):
        return "invalid_content_type"
    if isinstance(error, ValueError) and "unsupported" in str(error):
        return "unsupported_feature"
    return "unknown"
