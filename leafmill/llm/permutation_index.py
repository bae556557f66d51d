"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  It is posted in the
inverted files of its nearest few pivots; a query visits the files of its own
nearest few, ranks what it meets by the footrule distance between the two
orders, and what ranks best is scored exactly.

A query's best ``candidates`` rows by footrule are wanted over all its files
together, and no file knows the others.  So the distance at which that many
rows are met is read off a sample of the rows before the search, and each file
scores what lies within it: one list a query, of that length on average.

The number of pivots grows with the root of the number of vectors, files
opened and candidates grow along, see ``settings``.  Pivots are fitted on a
bounded, seeded sample; every vector is indexed.

Largest inner product is turned into nearest neighbour by one more coordinate,
``sqrt(longest^2 - |x|^2)`` for rows and 0 for queries.  Equal vectors are one
entry: it keeps the ``k + 1`` smallest ids, which is all that a result can
hold, so many copies of one vector neither crowd out others nor fill a file.
Files are split into blocks of bounded size, and a query meets each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle


def _valid(values, dim: int | None) -> np.ndarray | None:
    """The vector in double precision, or None where it takes no part."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or (dim is not None and len(x) != dim) or not np.isfinite(x).all() or not x.any():
        return None
    return x


def settings(rows: int, k: int = 20) -> tuple[int, int, int]:
    """Pivots, files that a query opens, and candidates that it scores, for so many distinct vectors.

    One law for all sizes, without a step: pivots are the root of ``rows``,
    from 128 to 2,048; 28 of 128 files are opened and less of more; candidates
    are twelve times the root.  Up to 128 vectors, each is a pivot and heads
    its own file, so the files that a query opens hold its nearest rows.
    """
    root = math.isqrt(rows)
    pivots = min(2048, max(128, root))
    return pivots, max(k + 1, math.ceil(28 * (pivots / 128) ** 0.73)), min(rows, max(k + 1, 12 * root))


def _clean(dim: int, k: int, kind: str):
    """Valid vectors as little-endian numbers of ``kind``; copies within a batch are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = None if i is None else _valid(v, dim)
                if x is not None:
                    # Adding zero turns -0.0 into 0.0, so equal vectors have equal bytes.
                    ids.setdefault((x + 0.0).astype(kind).tobytes(), []).append(i)
            keys = list(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([sorted(ids[x])[: k + 1] for x in keys], pa.list_(pa.int64()))],
                names=["_vec", "_ids"],
            )

    return run


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def orders(x: np.ndarray, pivots: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` nearest pivots of each row, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    near = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < d.shape[1] else np.argsort(d, axis=1)
    by = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, by, 1).astype(np.int16)


def footrule(query: np.ndarray, rows: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distance of prefix orders; a pivot outside a prefix stands at its end.

    A pivot at place ``t`` of the query and ``j`` of the row adds ``|t - j|``;
    one that only the query has adds ``keep - t``.  The latter is what all of
    the query's pivots would add less ``keep - t`` for each that the row has,
    so a row's pivot adds ``|t - j| + t = max(2t - j, j)`` but for constants.
    """
    keep = rows.shape[1]
    twice = np.full(pivots, 2 * keep, np.int16)
    twice[query] = 2 * np.arange(len(query))
    step = np.arange(keep, dtype=np.int16)
    t = twice[rows]
    t -= step
    np.maximum(t, step, out=t)
    return t.sum(1, dtype=np.int32) + (keep * (keep + 1) // 2 - keep * keep)


def _lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into distances."""
    if query:
        return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True) * longest, np.zeros(len(x))])
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))])


def _post(pivots: np.ndarray, longest: float, keep: int, files: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                perm = orders(_lifted(_matrix(b.column(0).to_pylist(), kind), longest, False), pivots, keep)
                held = pa.array([p.tobytes() for p in perm], pa.binary())
                for j in range(files):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(perm[:, j].astype(np.int32)), held, *b.columns], names=["_file", "_perm", *b.schema.names]
                    )

    return run


def _ask(pivots: np.ndarray, longest: float, keep: int, files: int, kind: str, sample: np.ndarray, share: float):
    """Queries by file, with the footrule distance within which a ``share`` of the ``sample`` lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders_of_sample = sample.astype(np.intp)
        at = min(len(sample), math.ceil(share * len(sample))) - 1
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                perm = orders(_lifted(_matrix(b.column(0).to_pylist(), kind), longest, True), pivots, max(keep, files))
                cuts = [int(np.partition(footrule(p[:keep], orders_of_sample, len(pivots)), at)[at]) if share < 1 else 1 << 30 for p in perm]
                held = [pa.array([p[:keep].tobytes() for p in perm], pa.binary()), pa.array(cuts, pa.int32())]
                for j in range(files):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(perm[:, j].astype(np.int32)), *held, *b.columns], names=["_file", "_perm", "_cut", *b.schema.names]
                    )

    return run


def _search(pivots: int, candidates: int, k: int, kind: str):
    """One block of a file against the queries that visit it: each query's best ``k + 1`` entries here.

    Scored are the rows within the query's distance, ``candidates`` at most and
    ``k + 1`` at least, ties to smaller ids.
    """

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names, n, m = ["query_id", "score", "_ids"], queries.num_rows, rows.num_rows
        if not n or not m:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.list_(pa.int64()))], names=names)
        order = lambda t: np.frombuffer(b"".join(t.column("_perm").to_pylist()), np.int16).reshape(t.num_rows, -1)
        x, q = (_matrix(t.column("_vec").to_pylist(), kind) for t in (rows, queries))
        ids = rows.column("_ids").combine_chunks()
        first = np.array([i[0].as_py() for i in ids])
        # Rows stand in the order of their first ids, so stable sorts settle ties.
        by = np.argsort(first, kind="stable")
        x, perm, asked, cuts = x[by], order(rows).astype(np.intp)[by], order(queries), queries.column("_cut").to_pylist()
        owner, entry, scores = [], [], []
        for i in range(n):
            far = footrule(asked[i], perm, pivots)
            best = np.flatnonzero(far <= cuts[i])
            if len(best) <= k or len(best) > candidates:
                best = np.sort(np.argsort(far, kind="stable")[: min(m, k + 1 if len(best) <= k else candidates)])
            score = np.einsum("ij,j->i", x[best], q[i])
            if len(best) > k + 1:
                edge = np.partition(score, len(best) - k - 1)[len(best) - k - 1]
                top = np.flatnonzero(score >= edge)
                top = top[np.argsort(-score[top], kind="stable")[: k + 1]]
                best, score = best[top], score[top]
            owner.append(np.full(len(best), i)), entry.append(by[best]), scores.append(score)
        asked_by = queries.column("_query").combine_chunks()
        found = [asked_by.take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(scores)), ids.take(pa.array(np.concatenate(entry)))]
        return pa.Table.from_arrays(found, names=names)

    return run


def nearest(
    vectors: DataFrame,
    is_query: str = "vec_id % 20 = 0",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    pivots: int | None = None,
    query_files: int | None = None,
    candidates: int | None = None,
    keep: int = 64,
    row_files: int = 4,
    sample: int = 8192,
    block: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for each query.

    Queries are the rows that ``is_query`` selects; candidates are all rows
    but the query's own.  ``score`` is the exact inner product in double
    precision; ties go to the smaller id.  ``pivots``, ``query_files`` and
    ``candidates`` follow the number of distinct vectors (``settings``) unless
    given; pivots and footrule distances are fitted on ``sample`` vectors.

    Defined cases: a null id or vector, null or non-finite components, the
    zero vector and vectors of another dimension than the first valid one take
    no part; rows that repeat an id and vector are one row; other columns are
    not read; an empty table gives an empty result; with up to 128 distinct
    vectors the result is exact.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    sized = source.where(F.col("_id").isNotNull() & (F.size("_v") > 0)).agg(F.min_by(F.size("_v"), "_id")).first()[0]
    if not sized:
        return spark.createDataFrame([], schema)
    entries = settle(
        source.mapInArrow(_clean(sized, k, kind), "_vec binary, _ids array<long>")
        .groupBy("_vec")
        .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))), 1, k + 1).alias("_ids")),
        "ann",
    )
    count = entries.count()
    chosen = entries.orderBy(F.xxhash64("_vec", F.lit(seed)), "_vec").limit(sample).select("_vec").collect()
    if not chosen:
        return spark.createDataFrame([], schema)
    longest = float(np.sqrt(entries.mapInArrow(_norms(kind), "n double").agg(F.max("n")).first()[0]))
    wanted = settings(count, k)
    pivots, query_files, candidates = (given or found for given, found in zip((pivots, query_files, candidates), wanted, strict=True))
    taken = _lifted(_matrix([bytes(r[0]) for r in chosen], kind), longest, False)
    base = _spread(taken, pivots)
    pivots = len(base)
    keep, row_files, query_files = (min(n, pivots) for n in (keep, row_files, query_files))
    posted = settle(
        entries.mapInArrow(_post(base, longest, keep, row_files, kind), "_file int, _perm binary, _vec binary, _ids array<long>"),
        "ann-files",
    )
    ask = _ask(base, longest, keep, query_files, kind, orders(taken, base, keep), min(1.0, candidates / count))
    asked = settle(
        source.where(F.expr(is_query.replace(id_col, "_id")))
        .mapInArrow(_one_by_one(sized, kind), "_vec binary, _query long")
        .distinct()
        .mapInArrow(ask, "_file int, _perm binary, _cut int, _vec binary, _query long"),
        "ann-queries",
    )
    # Files are split into blocks of rows and of queries; a cell is one block of each.
    split = lambda d, n: d.groupBy("_file").agg(F.ceil(F.count("*") / n).cast("long").alias("_cuts"))
    row_cuts, query_cuts = split(posted, block), split(asked, block)
    cuts = F.broadcast(  # one row per pivot
        row_cuts.withColumnRenamed("_cuts", "_r").join(query_cuts.withColumnRenamed("_cuts", "_q"), "_file")
    )
    rows = posted.join(cuts, "_file").select(
        "_file",
        F.pmod(F.xxhash64("_vec"), "_r").alias("_row_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)).alias("_query_block"),
        "_perm",
        "_vec",
        "_ids",
    )
    queries = asked.join(cuts, "_file").select(
        "_file",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1)).alias("_row_block"),
        F.pmod(F.xxhash64("_query"), "_q").alias("_query_block"),
        "_perm",
        F.col("_cut"),
        "_vec",
        "_query",
    )
    cell = ["_file", "_row_block", "_query_block"]
    found = (
        queries.groupBy(*cell)
        .cogroup(rows.groupBy(*cell))
        .applyInArrow(_search(pivots, candidates, k, kind), "query_id long, score double, _ids array<long>")
        .select("query_id", F.explode("_ids").alias("vec_id"), "score")
        .where("vec_id <> query_id")
        .distinct()
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _norms(kind: str):
    def run(batches):
        for b in batches:
            raw = b.column(0).to_pylist()
            if raw:
                yield pa.RecordBatch.from_arrays([pa.array([float((_matrix(raw, kind) ** 2).sum(1).max())])], names=["n"])

    return run


def _one_by_one(dim: int, kind: str):
    def run(batches):
        for b in batches:
            found = [(x + 0.0, i) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if i is not None and (x := _valid(v, dim)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype(kind).tobytes() for x, _ in found], pa.binary()), pa.array([i for _, i in found], pa.int64())],
                names=["_vec", "_query"],
            )

    return run


def _spread(points: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` of the sampled points as pivots, by k-means means (bounded rounds)."""
    if len(points) <= most:
        return points
    centres = points[:most].copy()
    for _ in range(6):
        d = (centres**2).sum(1)[None, :] - 2 * points @ centres.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=most)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres
