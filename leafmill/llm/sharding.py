"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (documents with equal texts) are sorted by size and each
enters the tightest bin that still has room; the bins stand in a balanced
tree by remaining capacity.  The smallest capacity for which the wanted
number of bins suffices is found by bisection, so shard sizes come out nearly
equal.

All groups enter the packing.  Groups of equal size are dealt as one run: the
tightest bin stays the tightest while it takes them, so a run fills it as far
as it goes and then the next.  The packer therefore needs one row per distinct
size (n sizes add up to at least n * n / 2 bytes, so there are few), and a
group finds its shard by its rank among the groups of its size.
"""

from __future__ import annotations

from itertools import accumulate, groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import join_hot, settle


class CapacityTree:
    """Bins in a balanced search tree (a treap), keyed by remaining capacity and bin number."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.state = 88172645463325252

    def _priority(self) -> int:
        x = self.state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self.state = x
        return x

    # A node is [key, priority, left, right].
    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        low, high = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(low, [(room, number), self._priority(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that is at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        least = high
        while least[2] is not None:
            least = least[2]
        found = least[0]
        _, rest = self._split(high, (found[0], found[1] + 1))
        self.root = self._merge(low, rest)
        return found


def deal_runs(runs: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Best-fit-decreasing of ``(size, count)`` runs of strictly falling size: per run its ``(items, bin)`` pieces in order.

    The same as placing the items one by one, opening a bin only where none
    has room.  ``None`` if an item exceeds ``capacity`` or more than
    ``most_bins`` bins would be needed.  Ties go to the lower bin number.
    """
    tree, used, out = CapacityTree(), 0, []
    for size, left in runs:
        if size > capacity:
            return None
        pieces = []
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if used == most_bins:
                    return None
                found = (capacity, used)
                used += 1
            n = min(left, found[0] // size)
            tree.add(found[0] - n * size, found[1])
            pieces.append((n, found[1]))
            left -= n
        out.append(pieces)
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """Bin of each item, or ``None`` as in ``deal_runs``.  Ties go to the lower item and bin number."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    dealt = deal_runs([(s, len(list(g))) for s, g in groupby(sizes[i] for i in order)], capacity, most_bins)
    if dealt is None:
        return None
    out, bins = [0] * len(sizes), [b for pieces in dealt for n, b in pieces for _ in range(n)]
    for i, b in zip(order, bins, strict=True):
        out[i] = b
    return out


def deal_evenly(runs: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int]]]:
    """``deal_runs`` at the least capacity (to 1/10000) that ``bins`` bins allow.

    An item above the fair share of what is left has a bin alone, from the
    last bin down, so that the others still come out even.
    """
    total, runs, alone = sum(s * n for s, n in runs), list(runs), {}
    while bins > 1 and runs and runs[0][0] * bins > total:
        size, n = runs[0]
        bins, total = bins - 1, total - size
        alone.setdefault(size, []).append((1, bins))
        runs[:1] = [(size, n - 1)] if n > 1 else []
    low = max(-(-total // bins), runs[0][0] if runs else 0)
    step = grain = max(1, total // bins // 10_000)
    best, high = deal_runs(runs, low, bins), low
    while best is None:
        low, high, step = high + 1, high + step, step * 2
        best = deal_runs(runs, high, bins)
    while high - low >= grain:
        middle = (low + high) // 2
        found = deal_runs(runs, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    if runs and runs[0][0] in alone:
        best[0] = alone.pop(runs[0][0]) + best[0]
    return [*alone.values(), *best]


def shard(
    docs: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_cell: int = 50_000,
    parts: int = 4096,
) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes.

    Returns ``(<id_col>, size, text_crc32, law, shard, slot, grown_shard)``;
    ``law`` is ``bytes``.  ``size`` is the text's UTF-8 bytes plus 1 (null: 1).
    Equal texts stay together, null with the empty text, unless they exceed a
    shard's fair share: such a group is cut, by the hash of its ids, into the
    fewest pieces of at most a quarter of that share.  Slots of a shard count
    from 0 without gaps.

    A size that ``1/parts`` of the groups have, or a group that ``1/parts`` of
    the rows are in, is dealt to many tasks; there are at most ``parts`` of
    either.

    Defined cases: null ids are ordinary values and come first in their cell;
    repeated rows each get a slot; an empty table gives an empty result; other
    columns are not read.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = settle(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(body) + F.lit(1)).cast("long").alias("_size"),
            F.crc32(body).alias("_crc"),
            F.unhex(F.substring(F.sha2(body, 256), 1, 32)).alias("_text"),
        ),
        "shard",
    )
    total, count = rows.agg(F.sum("_size"), F.count("*")).first()
    spark, share = docs.sparkSession, max(1, (total or 0) // shards)
    # Fewer than `shards` groups can exceed a shard's share.
    cut = settle(
        rows.groupBy("_text")
        .agg(F.sum("_size").alias("_bytes"))
        .where(F.col("_bytes") > share)
        .select("_text", F.ceil(F.col("_bytes") / max(1, share // 4)).cast("int").alias("_cut")),
        "shard-cut",
    )
    marked = rows.join(F.broadcast(cut), "_text", "left").withColumn(
        "_part", F.pmod(F.xxhash64("_id"), F.coalesce("_cut", F.lit(1))).cast("int")
    )
    groups = settle(marked.groupBy("_text", "_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_n")), "shard-groups")
    sizes = groups.groupBy("_bytes").agg(F.count("*").alias("_n")).toArrow().sort_by([("_bytes", "descending")])
    items, runs = groups.count(), list(zip(sizes["_bytes"].to_pylist(), sizes["_n"].to_pylist(), strict=True))
    plan, common = [], []
    for (size, n), pieces in zip(runs, deal_evenly(runs, shards), strict=True):
        upto = list(accumulate(k for k, _ in pieces))
        plan.append((size, list(zip(upto, (b for _, b in pieces), strict=True))))
        if n * parts >= items:
            common.append((size, -(-n * parts // items)))
    plan = spark.createDataFrame(plan, "_bytes long, _dealt array<struct<upto: long, shard: int>>")
    common = spark.createDataFrame(common, "_bytes long, _cells long")
    spread = groups.join(F.broadcast(common), "_bytes", "left").select(
        "_text", "_part", "_bytes", "_n", F.pmod(F.xxhash64("_text", "_part"), F.coalesce("_cells", F.lit(1))).alias("_cell")
    )
    by_size = Window.partitionBy("_bytes").orderBy("_cell")
    starts = (
        spread.groupBy("_bytes", "_cell")
        .agg(F.count("*").alias("_k"))
        .select("_bytes", "_cell", (F.sum("_k").over(by_size) - F.col("_k")).alias("_start"))
        .join(plan, "_bytes")
    )
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("_bytes", "_cell").orderBy("_text", "_part")))
    homes = settle(
        ranked.join(starts, ["_bytes", "_cell"]).select(
            "_text",
            "_part",
            "_n",
            F.filter("_dealt", lambda d: d["upto"] >= F.col("_start") + F.col("_rank"))[0]["shard"].alias("shard"),
        ),
        "shard-homes",
    )
    cells = max(1, -(-count // (shards * rows_per_cell)))
    placed = join_hot(marked, homes, ["_text", "_part"], "_n", count, parts).select(
        "_id", "_size", "_crc", "shard", F.pmod(F.xxhash64("_id", "_crc"), F.lit(cells)).cast("int").alias("_cell")
    )
    before = (
        placed.groupBy("shard", "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_start",
            F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("_n"),
        )
        .drop("_n")
    )
    return (
        placed.withColumn(
            "_at", F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_id", "_crc", "_size"))
        )
        .join(before, ["shard", "_cell"])
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
