"""Scalar functions of spreadsheets, bibliographies and text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def excel_date(serial: Column) -> Column:
    """ISO date of a spreadsheet serial; serial 60 is the fictional 1900-02-29, below 1 is null."""
    day = F.floor(serial).cast("int")
    real = F.date_format(F.date_add(F.lit("1899-12-31").cast("date"), day - F.when(day > 60, 1).otherwise(0)), "yyyy-MM-dd")
    return F.when(serial < 1, F.lit(None)).when(day == 60, F.lit("1900-02-29")).otherwise(real)


def excel_datetime(serial: Column) -> Column:
    """Date, and the time unless it is midnight; a fraction that rounds to a whole day prints 24:00:00."""
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("int")
    time = F.format_string("%02d:%02d:%02d", (seconds / 3600).cast("int"), ((seconds % 3600) / 60).cast("int"), seconds % 60)
    return F.when(seconds == 0, excel_date(serial)).otherwise(F.concat_ws(" ", excel_date(serial), time))


def column_letter(number: Column) -> Column:
    """Letters of a 1-based column number, to three letters."""
    n = number.cast("int")
    letter = lambda k: F.char(F.lit(65) + k)
    one = letter(n - 1)
    two = F.concat(letter(((n - 27) / 26).cast("int")), letter((n - 1) % 26))
    three = F.concat(letter(((n - 703) / 676).cast("int")), letter(((n - 703) / 26).cast("int") % 26), letter((n - 1) % 26))
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(three)


def column_number(reference: Column) -> Column:
    """1-based column of an A1 reference: the leading letters in base 26."""
    letters = F.split(F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1)), "")
    return F.aggregate(
        F.filter(letters, lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64
    )


def row_number(reference: Column) -> Column:
    """Row of an A1 reference: all its digits."""
    return F.expr("try_cast('' as int)") if reference is None else F.nullif(F.regexp_replace(reference, "[^0-9]", ""), F.lit("")).cast("int")


#: Codes of built-in number formats (fixed values).
BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?",
    13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)",
    39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0",
    48: "##0.0E+0", 49: "@",
}


def builtin_format(number: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in BUILTIN_FORMATS.items() for x in kv])
    return F.try_element_at(pairs, number.cast("int"))


def number_kind(code: Column) -> Column:
    """What a number format shows: date, time, datetime, currency, percentage or number.

    Only the first section counts; escaped and quoted text and brackets are
    not signals, but a currency sign in quotes and ``[$`` are, and so are
    elapsed ``[h]``, ``[m]``, ``[s]``.  A lone ``m`` is no signal.
    """
    first = F.get(F.split(F.lower(code), ";"), F.lit(0))
    money_quoted = first.rlike(r'"[^"]*[$€£¥][^"]*"')
    bare = F.regexp_replace(F.regexp_replace(first, r"\\.", ""), r'"[^"]*"?', "")
    money = money_quoted | bare.contains("[$") | F.regexp_replace(bare, r"\[[^\]]*\]?", "").rlike("[$€£¥]")
    elapsed = bare.rlike(r"\[(h+|m+|s+)\]")
    body = F.regexp_replace(bare, r"\[[^\]]*\]?", "")
    date, time = body.rlike("[yd]"), body.rlike("[hs]") | elapsed
    return (
        F.when(date & time, "datetime")
        .when(date, "date")
        .when(time, "time")
        .when(money, "currency")
        .when(body.contains("%"), "percentage")
        .otherwise("number")
    )


def cell_display(kind: Column, number: Column, string: Column, boolean: Column) -> Column:
    """Text of a cell: integers without a fraction, TRUE and FALSE, strings as they are, empty for others."""
    whole = (F.abs(number) < 1e15) & (number == F.floor(number))
    shown = F.when(whole, number.cast("decimal(20,0)").cast("string")).otherwise(number.cast("string"))
    return (
        F.when(kind == "number", shown)
        .when(kind == "string", string)
        .when(kind == "boolean", F.when(boolean, "TRUE").otherwise("FALSE"))
        .otherwise("")
    )


def csv_escape(value: Column) -> Column:
    """Quoted if it holds a comma, quote or newline; quotes are doubled."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(value, '"', '""'), F.lit('"'))
    return F.when(value.rlike('[,"\n]'), quoted).otherwise(value)


def escape_html(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def written_title(html: Column) -> Column:
    """Title of a page as it is written: of its references only ``&lt;``, ``&gt;`` and ``&amp;`` are resolved.

    The ``title`` that the reader puts into the metadata has all of them resolved.
    """
    title = F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1))
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(reference), F.lit(char))
    return title


def split_page_range(pages: Column) -> Column:
    """``struct(kind, first, last)``: single, range or ambiguous."""
    p = F.trim(pages)
    rng = r"^(\d+)\s*(?:--|–|—|-)\s*(\d+)$"
    kind = F.when(p.rlike(r"^\d+$"), "single").when(p.rlike(rng), "range").otherwise("ambiguous")
    first = F.when(kind == "single", p).when(kind == "range", F.regexp_extract(p, rng, 1))
    last = F.when(kind == "range", F.regexp_extract(p, rng, 2))
    return F.struct(kind.alias("kind"), first.alias("first"), last.alias("last"))


def strip_ansi(value: Column) -> Column:
    return F.regexp_replace(value, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def normalize_whitespace(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def heading_level(font: Column, mode: Column) -> Column:
    """Level by the ratio of a font to the body's: from 1.8 one, from 1.4 two, else three."""
    ratio = F.when(mode == 0, F.lit(1.0)).otherwise(font / mode)
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).otherwise(3)


def rels_path(part: Column) -> Column:
    """Where an office package keeps a part's relationships."""
    return F.regexp_replace(part, r"^(.*?)([^/]*)$", "$1_rels/$2.rels")


def column_width_emu(width: Column) -> Column:
    """EMU of a column width in characters of seven pixels at 96 dpi."""
    return (F.floor(width * 7 + 5) * 9525).cast("long")


def row_height_emu(points: Column) -> Column:
    return F.round(points * 12700).cast("long")


def emu_to_points(emu: Column) -> Column:
    return emu / 12700


def emu_to_inches(emu: Column) -> Column:
    return emu / 914400


def parse_range(reference: Column) -> Column:
    """``struct(r1, c1, r2, c2)`` of ``A1:C3``; one cell is its own end, anything else is null."""
    cell = r"[A-Za-z]+[0-9]+"
    ends = F.split(reference, ":")
    first, last = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))
    made = F.struct(
        row_number(first).alias("r1"), column_number(first).alias("c1"), row_number(last).alias("r2"), column_number(last).alias("c2")
    )
    return F.when(reference.rlike(rf"^{cell}(:{cell})?$"), made)


def as_number(kind: Column, number: Column, string: Column) -> Column:
    """A cell as a number: numbers, and strings that are one from end to end; else null."""
    is_one = string.rlike(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$")
    return F.when(kind == "number", number).when((kind == "string") & is_one, string.try_cast("double"))


def as_bool(kind: Column, number: Column, string: Column, boolean: Column) -> Column:
    """A cell as a truth value: numbers are true unless 0; of strings only true, false, 1 and 0 count."""
    low = F.lower(string)
    return (
        F.when(kind == "boolean", boolean)
        .when(kind == "number", number != 0)
        .when(kind == "string", F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False))
    )


def partial_date(text: Column) -> Column:
    """``struct(year, month, day)`` of ``YYYY/MM/DD``, whatever of it is there; null without a year of four digits.

    A month outside 1 to 12 is dropped with its day, a day outside 1 to 31 alone.
    """
    parts = F.split(text, "/")
    number = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\+?[0-9]+$"), F.get(parts, F.lit(i)).try_cast("int"))
    month = F.when(number(1).between(1, 12), number(1))
    day = F.when(month.isNotNull() & number(2).between(1, 31), number(2))
    year = F.get(parts, F.lit(0))
    return F.when(year.rlike("^[0-9]{4}$"), F.struct(year.cast("int").alias("year"), month.alias("month"), day.alias("day")))


def percent_decode(text: Column) -> Column:
    """Bytes of a percent-encoded ASCII text; an escape that is not two hex digits is dropped.

    A plus sign stays, unlike in form data.
    """
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|%.{0,2}|[^%]+)"), F.lit(1))
    good = F.lit(r"^%[0-9A-Fa-f]{2}$")
    as_hex = F.transform(
        parts, lambda p: F.when(F.regexp_like(p, good), F.substring(p, 2, 2)).when(p.startswith("%"), F.lit("")).otherwise(F.hex(F.encode(p, "UTF-8")))
    )
    return F.unhex(F.array_join(as_hex, ""))


def data_uri(uri: Column) -> Column:
    """``struct(mime_type, data)`` of a ``data:`` address; null for others and for base64 that cannot be read."""
    header = F.regexp_extract(uri, r"(?s)^data:([^,]*),", 1)
    data = F.regexp_replace(uri, r"(?s)^data:[^,]*,", "")
    packed = header.endswith(";base64")
    mime = F.when(packed, F.regexp_replace(header, ";base64$", "")).when(header == "", "text/plain;charset=US-ASCII").otherwise(header)
    raw = F.when(packed, F.try_to_binary(F.regexp_replace(data, "[ \\r\\n]", ""), F.lit("base64"))).otherwise(percent_decode(data))
    return F.when(uri.rlike("(?s)^data:[^,]*,") & raw.isNotNull(), F.struct(mime.alias("mime_type"), raw.alias("data")))
