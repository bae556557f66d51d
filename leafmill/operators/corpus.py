"""Corpus analytics: features, prevalence, outliers, validation, coverage, word comparison, the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge-case rules: (type, column, ((threshold, severity), ...) from the highest) -- fixed values.
EDGE_RULES = (
    ("deep_table_nesting", "table_nesting", ((4, "rare"), (3, "unusual"))),
    ("many_paragraphs", "paragraphs", ((5000, "rare"), (2000, "unusual"), (1000, "noteworthy"))),
    ("many_tables", "tables", ((100, "rare"), (50, "unusual"))),
    ("many_fonts", "fonts", ((50, "rare"), (20, "unusual"))),
    ("many_colors", "colors", ((50, "unusual"),)),
    ("large_font", "font_half_points", ((288, "rare"), (144, "unusual"))),
    ("many_styles", "styles", ((50, "unusual"),)),
    ("images", "images", ((1, "info"),)),
    ("links", "links", ((1, "info"),)),
    ("page_breaks", "page_breaks", ((1, "info"),)),
)
#: Rising order of edge-case severities (fixed values).
EDGE_SEVERITIES = ("info", "noteworthy", "unusual", "rare")

#: Error texts to categories, first match first (fixed values).
ERROR_CATEGORIES = (
    ("compression", "zip_unsupported_compression"),
    ("zip", "zip_corruption"),
    ("content type", "invalid_content_type"),
    ("missing part", "missing_required_part"),
    ("namespace", "xml_namespace"),
    ("encoding", "xml_encoding"),
    ("utf-8", "xml_encoding"),
    ("xml", "xml_malformed"),
    ("unexpected element", "unexpected_element"),
    ("missing attribute", "missing_attribute"),
    ("invalid attribute", "invalid_attribute"),
    ("relationship", "broken_relationship"),
    ("target", "missing_target"),
    ("unsupported", "unsupported_feature"),
    ("not implemented", "not_implemented"),
    ("io error", "io_error"),
)


def kind_census(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def node_features(nodes: DataFrame) -> DataFrame:
    """Per-document features of a ``nodes`` table in one aggregation by ``doc_id``."""
    is_ = lambda *k: F.count_if(F.col("kind").isin(*k)).alias(k[0] + "s")
    return nodes.groupBy("doc_id").agg(
        is_("paragraph"),
        is_("heading"),
        is_("table"),
        is_("image"),
        is_("link"),
        is_("list"),
        is_("code_block"),
        F.max("depth").alias("max_depth"),
        F.bool_or(F.col("kind") == "strong").alias("has_bold"),
        F.bool_or(F.col("kind") == "emphasis").alias("has_italic"),
        F.count("*").alias("nodes"),
    )


def prevalence(features: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``(feature, n_docs, total, pct)`` of each flag; 0 % of an empty corpus."""
    one = features.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("n_docs")) for n in flags])).alias("p")
    return one.select("total", pairs).select(
        "p.feature", "p.n_docs", "total", F.round(F.coalesce(F.try_divide(F.col("p.n_docs") * 100.0, F.col("total")), F.lit(0.0)), 6).alias("pct")
    )


def edge_cases(features: DataFrame, rules=EDGE_RULES, id_col: str = "doc_id") -> DataFrame:
    """``(<id>, case_type, value, severity, severity_rank)``, one row per rule that fires."""
    made = []
    for name, column, ladder in rules:
        if column not in features.columns:
            continue
        value, severity = F.col(column).cast("long"), None
        for at, label in ladder:
            severity = F.when(value >= at, label) if severity is None else severity.when(value >= at, label)
        made.append(F.when(severity.isNotNull(), F.struct(F.lit(name).alias("case_type"), value.alias("value"), severity.alias("severity"))))
    cases = features.select(id_col, F.explode(F.array_compact(F.array(*made))).alias("c")).select(id_col, "c.*")
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(EDGE_SEVERITIES) for x in (s, i)])
    return cases.withColumn("severity_rank", ranks[F.col("severity")])


def interest_reason(cases: DataFrame, features: DataFrame, rules=EDGE_RULES, id_col: str = "doc_id") -> DataFrame:
    """``(<id>, reason, severity_rank)``: why a document is interesting; dull ones have no row.

    The first rare case in the order of ``rules``, else the first unusual one,
    else ``tables_and_images``, else ``nested_tables`` (deeper than one), else
    the first noteworthy case.  The two combinations have no rank.
    """
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r[0], i)])
    loud = cases.where("severity_rank >= 1").select(
        id_col, F.when(F.col("severity_rank") == 1, 4).otherwise(3 - F.col("severity_rank")).alias("_place"), order[F.col("case_type")].alias("_at"),
        F.col("case_type").alias("reason"), "severity_rank",
    )
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in features.columns else F.lit(0)
    both, nested = (has("tables") > 0) & (has("images") > 0), has("table_nesting") > 1
    made = features.where(both | nested).select(
        id_col, F.when(both, 2).otherwise(3).alias("_place"), F.lit(0).alias("_at"),
        F.when(both, "tables_and_images").otherwise("nested_tables").alias("reason"), F.lit(None).cast("int").alias("severity_rank"),
    )
    first = F.min(F.struct("_place", "_at", "reason", "severity_rank")).alias("f")
    return loud.unionByName(made).groupBy(id_col).agg(first).select(id_col, "f.reason", "f.severity_rank")


def error_category(message: Column) -> Column:
    low, out = F.lower(message), F.lit("unknown")
    for needle, name in reversed(ERROR_CATEGORIES):
        out = F.when(low.contains(needle), name).otherwise(out)
    return F.when(message.isNotNull(), out)


def corpus_stats(store: DataFrame) -> DataFrame:
    """Documents, successes and failures of each corpus; rates are 0 without documents."""
    return store.groupBy("corpus").agg(
        F.count("*").alias("total"),
        F.count_if("parse_success").alias("successes"),
        F.count_if(~F.col("parse_success")).alias("failures"),
        F.round(F.coalesce(F.try_divide(F.count_if("parse_success") * 100.0, F.count("*")), F.lit(0.0)), 6).alias("success_rate"),
    )


def upsert(store: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Last write per (path, corpus) wins: by ``order``, larger is later; a failure has no features and vice versa.

    Of equal ``order`` values the row with the larger content digest wins, so reruns agree.
    """
    w = Window.partitionBy("path", "corpus").orderBy(F.col(order).desc(), F.xxhash64(*[F.col(c) for c in store.columns]).desc())
    return (
        store.unionByName(new)
        .withColumn("_k", F.row_number().over(w))
        .where("_k = 1")
        .drop("_k")
        .withColumn("features_json", F.when(F.col("parse_success"), F.col("features_json")))
        .withColumn("error_category", F.when(~F.col("parse_success"), F.col("error_category")))
    )


def words(text: Column) -> Column:
    """Case-folded words of letters only, of two bytes or more (so a lone accented letter counts)."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+")
    clean = F.transform(parts, lambda w: F.regexp_replace(w, r"[^\p{L}]", ""))
    return F.filter(clean, lambda w: F.octet_length(w) >= 2)


def word_counts(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col), F.explode(words(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def word_coverage(reference: DataFrame, ours: DataFrame, id_col: str, ids: DataFrame | None = None) -> DataFrame:
    """Share of each reference's words that ``ours`` (one multiset, ``word, n``) has; 1 without words.

    ``ids`` names the references; without it those without words have no row.
    """
    total = reference.groupBy(id_col).agg(F.sum("n").alias("_t"))
    got = (
        reference.join(ours.withColumnRenamed("n", "_o"), "word", "left")
        .groupBy(id_col)
        .agg(F.sum(F.least("n", F.coalesce("_o", F.lit(0)))).alias("_g"))
    )
    counted = total.join(got, id_col)
    if ids is not None:
        counted = ids.select(id_col).distinct().join(counted, id_col, "left").na.fill(0, ["_t", "_g"])
    return counted.select(id_col, F.col("_t").alias("ref_words"), F.col("_g").alias("found"), F.round(F.coalesce(F.try_divide("_g", "_t"), F.lit(1.0)), 6).alias("coverage"))


def missing_words(reference: DataFrame, ours: DataFrame) -> DataFrame:
    """``(word, deficit)`` where ``reference`` has more of a word than ``ours``, largest first."""
    return (
        reference.join(ours.withColumnRenamed("n", "_o"), "word", "left")
        .select("word", (F.col("n") - F.coalesce("_o", F.lit(0))).alias("deficit"))
        .where("deficit > 0")
        .orderBy(F.col("deficit").desc(), "word")
    )


def attribute_report(counts: DataFrame, total: Column) -> DataFrame:
    """``(name, n, pct, marker)``: how often an attribute is set and its marker."""
    pct = F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0))
    return counts.select(
        "name", "n", F.round(pct, 6).alias("pct"), F.when(pct > 50, "***").when(pct > 10, "**").when(pct > 1, "*").otherwise("").alias("marker")
    )


def uncommon(values: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` that ``known`` does not have, whatever their case."""
    folded = known.select(F.lower(column).alias("_k")).distinct()
    return values.select(column).distinct().join(folded, F.lower(F.col(column)) == F.col("_k"), "left_anti")


def validation_stats(issues: DataFrame, documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(valid, warnings_only, errors)`` documents; ``issues`` has a ``severity`` of warning or error."""
    worst = issues.groupBy(id_col).agg(F.bool_or(F.col("severity") == "error").alias("_bad"))
    joined = documents.select(id_col).distinct().join(worst, id_col, "left")
    return joined.agg(
        F.count_if(F.col("_bad").isNull()).alias("valid"),
        F.count_if(~F.col("_bad")).alias("warnings_only"),
        F.count_if("_bad").alias("errors"),
    )


def issues_by_code(issues: DataFrame) -> DataFrame:
    """``(severity, code, n)``: how often each code of a warning or an error was raised."""
    return issues.groupBy("severity", "code").agg(F.count("*").alias("n"))


#: Conditions of ``matching``, by feature name.
WANTED = {"tables": "tables", "images": "images", "hyperlinks": "links", "lists": "lists"}


def matching(
    features: DataFrame,
    cases: DataFrame | None = None,
    most_paragraphs: int | None = None,
    has: tuple[str, ...] = (),
    min_severity: str | None = None,
    case_types: tuple[str, ...] = (),
    id_col: str = "doc_id",
) -> DataFrame:
    """Rows of ``features`` that meet every condition given; without conditions all of them.

    ``has`` names features of ``WANTED``; any one of ``case_types`` is enough.
    """
    out = features
    if most_paragraphs is not None:
        out = out.where(F.col("paragraphs") <= most_paragraphs)
    for name in has:
        out = out.where(F.col(WANTED[name]) > 0)
    for held in (
        None if min_severity is None else F.col("severity_rank") >= EDGE_SEVERITIES.index(min_severity),
        F.col("case_type").isin(*case_types) if case_types else None,
    ):
        if held is not None:
            out = out.join(cases.where(held).select(id_col), id_col, "left_semi")
    return out


def preset(name: str) -> dict:
    """Arguments of ``matching``: ``interesting``, ``minimal``, or a feature; an unknown feature filters nothing."""
    if name == "interesting":
        return {"min_severity": "unusual"}
    if name == "minimal":
        return {"most_paragraphs": 50}
    return {"has": (name,)} if name in WANTED else {}


def feature_totals(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``max_<c>`` and ``sum_<c>`` of each column."""
    return features.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("max", F.max), ("sum", F.sum))])


def distribution(rows: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """``(value, n_docs)``: in how many documents each value stands."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.countDistinct(id_col).alias("n_docs"))


def element_coverage(seen: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(element, known, n, n_docs, pct)`` of all elements seen or known.

    ``seen`` has a row per occurrence, ``known`` one per element; ``pct`` is the
    share of documents, 0 where there are none.  Missing elements are known
    ones with ``n`` 0; unknown ones are those seen but not known.
    """
    counts = seen.groupBy("element").agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("n_docs"))
    total = seen.agg(F.countDistinct(id_col)).scalar()
    listed = known.select("element").distinct().withColumn("known", F.lit(True))
    joined = counts.join(listed, "element", "full").na.fill(0, ["n", "n_docs"]).na.fill(False, ["known"])
    pct = F.round(F.coalesce(F.try_divide(F.col("n_docs") * 100.0, total), F.lit(0.0)), 6).alias("pct")
    return joined.select("element", "known", "n", "n_docs", pct)


def coverage_share(coverage: DataFrame) -> DataFrame:
    """``(found, known, pct)`` of an ``element_coverage``; null where nothing is known."""
    found = F.count_if(F.col("known") & (F.col("n") > 0))
    return coverage.agg(
        found.alias("found"), F.count_if("known").alias("known"), F.round(F.try_divide(found * 100.0, F.count_if("known")), 6).alias("pct")
    )


def merge_counts(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Sums by ``keys`` of the number columns of count tables; partial sums merge in any order."""
    all_rows = tables[0]
    for t in tables[1:]:
        all_rows = all_rows.unionByName(t, allowMissingColumns=True)
    numbers = [c for c in all_rows.columns if c not in keys]
    return all_rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])


def corpora(store: DataFrame) -> DataFrame:
    return store.select("corpus").distinct()


def without_corpus(store: DataFrame, corpus: str) -> DataFrame:
    """The store without a corpus; rows of no corpus stay."""
    return store.where(~F.col("corpus").eqNullSafe(F.lit(corpus)))


def failures(store: DataFrame, corpus: str | None = None, category: str | None = None) -> DataFrame:
    """Failed documents, of one corpus or one category if given."""
    out = store.where(~F.col("parse_success"))
    out = out if corpus is None else out.where(F.col("corpus") == corpus)
    return out if category is None else out.where(F.col("error_category") == category)


def failures_by_category(store: DataFrame) -> DataFrame:
    return failures(store).groupBy("error_category").agg(F.count("*").alias("n"))


def lookup(store: DataFrame, path: str, corpus: str) -> DataFrame:
    """The row of one document, or none; both conditions reach the scan."""
    return store.where((F.col("path") == path) & (F.col("corpus") == corpus))


def first_files(files: DataFrame, n: int, order: str = "path") -> DataFrame:
    """The first ``n`` files by name, before any is parsed."""
    return files.orderBy(order).limit(n)


def mode_size(sizes: DataFrame, column: str) -> DataFrame:
    """``(mode_size, n)``: the commonest size, in half points; of ties the smallest."""
    half = F.round(F.col(column) * 2).cast("long").alias("half")
    counts = sizes.groupBy(half).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "half").limit(1).select((F.col("half") / 2.0).alias("mode_size"), "n")
