"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
belongs to).  A flow routes each pattern's token capacity to the quotas of its
sources; the first pass over a pattern is free and every further pass costs
more than the one before, so repetition is spread as thinly as the targets
allow.  Each pattern's routed tokens then become whole repeats of all its
documents plus one more repeat of a seeded selection.

The driver only sees one row per membership pattern; a mixture names its
sources, so that table has the size of a configuration, and more patterns than
``most_patterns`` are refused.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, settle


def fill_targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Share ``sum(sizes)`` by weight; no target exceeds ``most`` times its size.

    What a capped source cannot use is shared again by weight until no target
    is above its cap.
    """
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]} if weight else set(free)
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in over)
        free -= over
    return targets


def min_cost_flow(arcs: list[tuple[int, int, int, int]], nodes: int, source: int, sink: int) -> list[int]:
    """Flow on each ``(from, to, capacity, cost)`` arc of a cheapest maximal flow.

    Successive shortest paths with potentials; costs are not negative.
    """
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, c, w in arcs:
        out[a].append(len(to))
        to.append(b), room.append(c), cost.append(w)
        out[b].append(len(to))
        to.append(a), room.append(0), cost.append(-w)
    height = [0] * nodes
    while True:
        dist, via = [math.inf] * nodes, [-1] * nodes
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                if room[e] and (nd := d + cost[e] + height[a] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if dist[sink] == math.inf:
            return [room[2 * k + 1] for k in range(len(arcs))]
        for a in range(nodes):
            if dist[a] < math.inf:
                height[a] += dist[a]
        step, a = math.inf, sink
        while a != source:
            step = min(step, room[via[a]])
            a = to[via[a] ^ 1]
        a = sink
        while a != source:
            room[via[a]] -= step
            room[via[a] ^ 1] += step
            a = to[via[a] ^ 1]


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[float], passes: int = 3) -> list[int]:
    """Tokens that each ``(sources, size)`` pattern contributes in total.

    Pass ``k`` over a pattern costs ``k*k`` a token, so costs are convex.
    """
    p, s = len(patterns), len(targets)
    sink, arcs = p + s + 1, []
    for i, (members, size) in enumerate(patterns):
        arcs += [(0, 1 + i, size, k * k) for k in range(passes)]
    first = len(arcs)
    for i, (members, size) in enumerate(patterns):
        arcs += [(1 + i, 1 + p + j, passes * size, 0) for j in members]
    arcs += [(1 + p + j, sink, round(t), 0) for j, t in enumerate(targets)]
    flow = min_cost_flow(arcs, sink + 1, 0, sink)
    return [sum(flow[passes * i : passes * i + passes]) for i in range(p)] if first else []


def _keyed(docs: DataFrame, members: str | Column, id_col: str, seed: int, buckets: int) -> DataFrame:
    """Add what decisions go by: the id, the seeded hash and its range, the distinct sources and their text form."""
    of = F.array_sort(F.array_distinct(F.col(members) if isinstance(members, str) else members))
    u = F.xxhash64(F.col(id_col), F.lit(seed))
    return docs.withColumns(
        {
            "_mix_id": F.col(id_col),
            "_mix_u": u,
            "_mix_bucket": F.pmod(F.shiftrightunsigned(u, 40), F.lit(buckets)).cast("int"),
            "_mix_members": of,
            "_mix_pattern": F.to_json(F.struct(of.alias("m")), {"ignoreNullFields": "false"}),
        }
    )


def _decide(
    docs: DataFrame,
    members: str | Column,
    id_col: str,
    text_col: str,
    weights: tuple[float, ...],
    passes: int,
    seed: int,
    buckets: int,
    most_patterns: int,
) -> tuple[DataFrame, DataFrame]:
    """Rows without their texts, and one row per membership pattern that says which documents repeat how often."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = settle(
        _keyed(docs.select(F.col(id_col), F.col(text_col), (F.col(members) if isinstance(members, str) else members).alias("_mix_of")), "_mix_of", id_col, seed, buckets)
        .select("_mix_id", "_mix_u", "_mix_bucket", "_mix_members", "_mix_pattern", size.alias("_mix_size")),
        "mix",
    )
    found = rows.groupBy("_mix_pattern").agg(F.first("_mix_members").alias("m"), F.sum("_mix_size").alias("n")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns; a mixture names its sources")
    found.sort(key=lambda r: r["_mix_pattern"] or "")
    named = sorted({x for r in found for x in (r["m"] or [])}, key=lambda x: (x is None, x or ""))
    at = {x: i for i, x in enumerate(named)}
    sizes = [0] * len(named)
    for r in found:
        for x in r["m"] or []:
            sizes[at[x]] += r["n"]
    whole = sum(r["n"] for r in found if r["m"])
    scale = whole / sum(sizes) if sum(sizes) else 1.0
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(named))], passes)
    # Sizes of overlapping sources count shared documents twice; quotas share the words there are.
    quotas = [t * scale for t in targets]
    routed = route([(tuple(at[x] for x in r["m"] or []), r["n"]) for r in found], quotas, passes)
    plan = spark.createDataFrame(
        [
            (
                r["_mix_pattern"],
                int(sizes[at[r["m"][0]]]) if r["m"] else 0,
                float(targets[at[r["m"][0]]]) if r["m"] else 0.0,
                f // r["n"] if r["n"] else 0,
                f % r["n"] if r["n"] else 0,
            )
            for r, f in zip(found, routed, strict=True)
        ],
        "_mix_pattern string, _mix_source long, _mix_target double, _mix_base long, _mix_rest long",
    )
    return rows, settle(_limits(rows, plan), "mix-limits")


def _limits(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Where the seeded choice worth ``_mix_rest`` words ends in each pattern.

    Documents enter in the order of their seeded hash until the next would
    exceed the rest; then the document whose size is nearest to the gap enters
    too.  Words are first summed by ranges of the hash, so only documents of
    the range where the limit falls are ever sorted together.
    """
    held = rows.join(F.broadcast(plan), "_mix_pattern")
    sums = held.groupBy("_mix_pattern", "_mix_rest", "_mix_bucket").agg(F.sum("_mix_size").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_mix_pattern").orderBy("_mix_bucket"))
    ends = settle(sums.withColumn("_upto", upto).where("_upto > _mix_rest"), "mix-ends")
    # The first range that does not fit whole, and the words before it.
    edges = ends.groupBy("_mix_pattern").agg(F.min(F.struct("_mix_bucket", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_e"))
    edges = edges.select("_mix_pattern", F.col("_e._mix_bucket").alias("_mix_edge"), F.col("_e._before").alias("_before"))
    w = Window.partitionBy("_mix_pattern").orderBy("_mix_u", "_mix_id")
    last = (
        held.join(F.broadcast(edges), "_mix_pattern")
        .where("_mix_bucket = _mix_edge")
        .withColumn("_sum", F.col("_before") + F.sum("_mix_size").over(w))
        .where("_sum <= _mix_rest")
        .groupBy("_mix_pattern")
        .agg(F.max(F.struct("_mix_u", "_mix_id", "_sum")).alias("_last"))
    )
    limits = (
        plan.join(edges, "_mix_pattern", "left")
        .join(last, "_mix_pattern", "left")
        .select(
            *plan.columns,
            "_mix_edge",
            F.col("_last._mix_u").alias("_mix_lu"),
            F.col("_last._mix_id").alias("_mix_lid"),
            (F.col("_mix_rest") - F.coalesce("_last._sum", "_before")).alias("_mix_gap"),
        )
    )
    off = F.abs(F.col("_mix_gap") - F.col("_mix_size"))
    extra = (
        rows.join(F.broadcast(limits), "_mix_pattern")
        .where(~_inside() & (F.col("_mix_size") > 0) & (off < F.col("_mix_gap")))
        .groupBy("_mix_pattern")
        .agg(F.min(F.struct(off.alias("d"), "_mix_u", "_mix_id")).alias("_x"))
        .select("_mix_pattern", F.col("_x._mix_u").alias("_mix_xu"), F.col("_x._mix_id").alias("_mix_xid"))
    )
    return limits.join(extra, "_mix_pattern", "left")


def _inside():
    """Whether a row comes before its pattern's limit."""
    low = F.lit(-(1 << 63))
    before = (F.col("_mix_u") < F.col("_mix_lu")) | (
        (F.col("_mix_u") == F.col("_mix_lu")) & (F.coalesce(F.col("_mix_id").cast("long"), low) <= F.coalesce(F.col("_mix_lid").cast("long"), low))
    )
    at_edge = (F.col("_mix_bucket") == F.col("_mix_edge")) & F.coalesce(before, F.lit(False))
    return F.col("_mix_edge").isNull() | (F.col("_mix_bucket") < F.col("_mix_edge")) | at_edge


def _applied(keyed: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """Add the column ``name``: how often each row is used.  No row moves: there is one limit row per pattern."""
    extra = F.coalesce((F.col("_mix_u") == F.col("_mix_xu")) & F.col("_mix_id").eqNullSafe(F.col("_mix_xid")), F.lit(False))
    return keyed.join(F.broadcast(limits), "_mix_pattern").withColumn(
        name, F.col("_mix_base") + ((F.col("_mix_rest") > 0) & (_inside() | extra)).cast("long")
    )


def mix(
    docs: DataFrame,
    members: str | Column = "sources",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, ...] = (1, 2, 3),
    passes: int = 3,
    seed: int = 42,
    buckets: int = 4096,
    most_patterns: int = 10_000,
) -> DataFrame:
    """Decide how often each document is used.

    ``docs`` has an array column ``members`` with the sources of each document
    (null elements are a source of their own).  Sources in code-point order,
    null last, get ``weights`` in rotation.  Returns ``(<id_col>, size,
    source_size, target, taken, repeats)`` with one row per input row;
    ``source_size`` and ``target`` belong to the first member source.

    Defined cases: a null or empty membership takes no part (``taken`` 0,
    ``target`` 0); a null text has size 0 and is taken with 0 words; repeated
    rows are separate documents with equal seeds, taken together; an empty
    table gives an empty result; a source without words has target 0; more
    than ``most_patterns`` different memberships are an error.

    A source's taken words differ from its routed tokens by what one best
    fitting document leaves open, see ``_limits``.
    """
    rows, limits = _decide(docs, members, id_col, text_col, weights, passes, seed, buckets, most_patterns)
    return _applied(rows, limits, "_mix_repeats").select(
        F.col("_mix_id").alias(id_col),
        F.col("_mix_size").alias("size"),
        F.col("_mix_source").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_repeats")).alias("taken"),
        F.col("_mix_repeats").alias("repeats"),
    )


def repeat_by_mix(
    docs: DataFrame,
    members: str | Column = "sources",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: tuple[float, ...] = (1, 2, 3),
    passes: int = 3,
    seed: int = 42,
    buckets: int = 4096,
    most_patterns: int = 10_000,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; texts stay where they are.

    Cases are those of ``mix``.  Names that begin with ``_mix_`` are used
    inside; columns of such names are an error.
    """
    if clash := [c for c in docs.columns if c.startswith("_mix_")]:
        raise ValueError(f"columns {clash} are used inside")
    _, limits = _decide(docs, members, id_col, text_col, weights, passes, seed, buckets, most_patterns)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (
        _applied(_keyed(docs, members, id_col, seed, buckets), limits, "_mix_repeats")
        .where("_mix_repeats > 0")
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_repeats").cast("int"))))
        .select(*columns)
    )
