"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other meet in a variant that
lies within half the radius of both.  Emitting every variant of all 64 bits at
radius 4 means 2,081 rows a fingerprint, so the ball is taken on halves: of
the at most four differing bits, one 32-bit half holds at most two, and on
that half variants within one bit meet.  That is 66 rows a fingerprint and no
pair within the radius is lost.  Fingerprints are deduplicated before they
emit, variants are shuffled and sorted, and each bucket of equal variants is
verified on all 64 bits.

A bucket never emits all its pairs: it emits links that span its groups, at
most one less than its members.  Buckets too large for a distance matrix are
linked by ball hashing over all 64 bits, where every bucket is linked as a
star because its members are within the radius by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, join_hot, settle
from .paragraph_dedup import _verify, band_keys, shingle_hashes, tune_bands

BITS = 64
#: Largest bucket compared as a matrix.
MATRIX = 2048
#: Variants held at a time when a larger bucket is linked.
SLICE = 4_000_000


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of a text as an unsigned 64-bit integer.

    A-Z are lower-cased, words are runs of non-space bytes, shingles (repeats
    included) are hashed by XXH64; a bit is set if it is set in over half of
    the hashes.  Fewer words than ``shingle`` form one shingle; none gives 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - k + 1]
    n, counts, digest = len(starts), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    stops = ends[k - 1 :] - 1
    for at in range(0, n, 65_536):
        part = zip(starts[at : at + 65_536].tolist(), stops[at : at + 65_536].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in part), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((simhash(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["_id", "_fp"])

    return run


def _spanning(near: np.ndarray) -> np.ndarray:
    """Smallest member reachable from each member, given the matrix of links."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def ball_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all fingerprints within ``radius``, by variants of all 64 bits.

    For an even radius each bucket's members are pairwise within the radius,
    so a star is enough.  Variants are visited in slices by their hash, which
    bounds memory.
    """
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    masks = [np.zeros(1, np.uint64), one]
    for _ in range(1, radius // 2):
        i, j = np.triu_indices(BITS, 1)
        masks.append(one[i] ^ one[j])
    masks = np.concatenate(masks[: radius // 2 + 1])
    slices = max(1, -(-len(fp) * len(masks) // SLICE))
    heads, tails = [], []
    for s in range(slices):
        keys, owners = [], []
        for at in range(0, len(fp), 4096):
            v = fp[at : at + 4096, None] ^ masks[None, :]
            hit = np.nonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices) == s)
            keys.append(v[hit])
            owners.append(hit[0] + at)
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        fresh = np.r_[True, keys[1:] != keys[:-1]]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
        star = ~fresh
        link = np.unique(np.stack([owners[first[star]], owners[star]]), axis=1)
        heads.append(fp[link[0]])
        tails.append(fp[link[1]])
    return np.concatenate(heads), np.concatenate(tails)


def bucket_links(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the members of each run of equal ``keys``."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    heads, tails = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for s in np.unique(size[size > 1]).tolist():
        at = start[size == s]
        if s <= 8:
            group = fp[at[:, None] + np.arange(s)]
            for i in range(s):
                for j in range(i + 1, s):
                    near = np.bitwise_count(group[:, i] ^ group[:, j]) <= radius
                    heads.append(group[near, i])
                    tails.append(group[near, j])
            continue
        for a in at.tolist():
            group = fp[a : a + s]
            if s > MATRIX and radius in (2, 4):
                h, t = ball_links(group, radius)
            else:
                low = _spanning(np.bitwise_count(group[:, None] ^ group[None, :]) <= radius)
                own = low != np.arange(s)
                h, t = group[low[own]], group[own]
            heads.append(h)
            tails.append(t)
    return np.concatenate(heads), np.concatenate(tails)


def _links(radius: int):
    def out(keys, fp):
        h, t = bucket_links(np.concatenate(keys), np.concatenate(fp).view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.view(np.int64))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []
        for b in batches:
            if not b.num_rows:
                continue
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last:
                # All but the batch's last key are complete.
                yield out([*keys, k[:last]], [*fps, f[:last]])
                keys, fps = [k[last:]], [f[last:]]
            elif keys and keys[-1][-1] != k[0]:
                yield out(keys, fps)
                keys, fps = [k], [f]
            else:
                keys.append(k)
                fps.append(f)
        if keys:
            yield out(keys, fps)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42):
    """``(_id, _fp)`` for each row, written once to the shared folder."""
    return settle(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
            _fingerprints(shingle, seed), "_id long, _fp long"
        ),
        "simhash",
    )


def near_groups(rows: DataFrame, radius: int = 4) -> DataFrame:
    """``(_fp, component_id, _n)`` for each distinct fingerprint of ``(_id, _fp)``, with its number of rows."""
    distinct = settle(rows.groupBy("_fp").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n")), "simhash-distinct")
    half = radius // 2
    if half not in (0, 1, 2, 3):
        raise ValueError("radius must be from 0 to 7")
    # One 32-bit half differs in at most `half` bits, so variants within half of that (rounded up) meet.
    reach = (half + 1) // 2
    flips = [0] + ([1 << i for i in range(32)] if reach else [])
    if reach > 1:
        flips += [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    halves = [
        (F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF)), 0),
        (F.shiftrightunsigned("_fp", 32), 1),
    ]
    keys = F.array(*[h.bitwiseXOR(F.lit(m)).bitwiseOR(F.lit(side << 32)) for h, side in halves for m in flips])
    variants = distinct.select(F.explode(keys).alias("_key"), "_fp")
    links = (
        variants.repartition(F.col("_key"))
        .sortWithinPartitions("_key")
        .mapInArrow(_links(radius), "src long, dst long")
        .distinct()
    )
    comp = connected_components(links, "simhash-cc")
    named = comp.join(distinct, comp["node"] == distinct["_fp"])
    root = named.groupBy("component").agg(F.min("_rep").alias("component_id"))
    linked = comp.join(root, "component").select(F.col("node").alias("_fp"), "component_id")
    return distinct.join(linked, "_fp", "left").select("_fp", F.coalesce("component_id", "_rep").alias("component_id"), "_n")


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 4,
    shingle: int = 4,
    seed: int = 42,
) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)``, one row per input row.

    ``fingerprint`` has 16 lowercase hex digits; fingerprints that differ in
    ``radius`` bits or fewer are linked and ``component_id`` is the smallest id
    reachable over links.

    Defined cases: null and wordless texts have fingerprint zero and are
    linked like any other; a null id takes part in its group but is never its
    component id unless all ids of the group are null; repeated rows are
    linked; an empty table gives an empty result; other columns are not read.
    """
    rows = fingerprints(docs, id_col, text_col, shingle, seed)
    groups = settle(near_groups(rows, radius), "simhash-groups")
    return join_hot(rows, groups, ["_fp"], "_n", rows.count()).select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


# -- near copies by similarity ----------------------------------------------------


def simhash_of_set(text: str | None, shingle: int = 2, seed: int = 42) -> int:
    """Fingerprint of the distinct ``shingle``-word runs of a text; one changed word moves it little."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    runs = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    h = np.fromiter((digest(r, seed) for r in runs), np.uint64, len(runs))
    for at in range(0, len(h), 65_536):
        counts += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _two_fingerprints(least: float, shingle: int):
    keys = band_keys(*tune_bands(least, rows=3), seed=12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            # Few texts at a time, as all their hashes are held.
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(1).to_pylist()
                found = [np.fromiter(map(f, texts), np.uint64, len(texts)).view(np.int64) for f in (simhash_of_set, simhash)]
                words = [_words(t) for t in texts]
                digests = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
                # No words count as one empty word, which no text has.
                bands = keys([shingle_hashes(w or [b""], shingle) for w in words])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), *map(pa.array, found), digests, bands],
                    names=["_id", "_hash", "_fp", "_check", "_digest", "_bands"],
                )

    return run


def _candidates(radius: int, wide: int):
    """Members of each bucket that agree on both fingerprints with one of another component; rows come sorted by key."""

    def near(fp, check, comp, i, j):
        return (np.bitwise_count(fp[i] ^ fp[j]) <= radius) & (np.bitwise_count(check[i] ^ check[j]) <= wide) & (comp[i] != comp[j])

    def met(k, fp, check, comp, node):
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[start, len(k)])
        hit = np.zeros(len(k), bool)
        for s in np.unique(size[size > 1]).tolist():
            at = start[size == s]
            if s <= 8:
                i, j = np.triu_indices(s, 1)
                step = max(1, 2_000_000 // len(i))
                for a in range(0, len(at), step):
                    x, y = ((at[a : a + step, None] + v[None, :]).ravel() for v in (i, j))
                    good = near(fp, check, comp, x, y)
                    hit[x[good]] = hit[y[good]] = True
                continue
            for a in at.tolist():
                for b in range(0, s, 512):
                    rows = np.arange(b, min(b + 512, s))
                    good = near(fp, check, comp, a + rows[:, None], a + np.arange(s)[None, :])
                    hit[a + rows] = good.any(axis=1)
        return k[hit], node[hit]

    def out(parts):
        found = met(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["_key", "_pid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            cols[1:3] = [c.view(np.uint64) for c in cols[1:3]]
            k = cols[0]
            last = int(np.searchsorted(k, k[-1]))
            if last or (parts and parts[-1][0][-1] != k[0]):
                yield out([*parts, tuple(c[:last] for c in cols)])
                parts = [tuple(c[last:] for c in cols)]
            else:
                parts.append(tuple(cols))
        if parts:
            yield out(parts)

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts that have the wanted digest; a repeated id may have others."""
    import xxhash

    for b in batches:
        found = [b" ".join(_words(t)) for t in b.column(2).to_pylist()]
        keep = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(found, b.column(1).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["_pid", "_text"]).filter(keep)


def _verified(docs: DataFrame, reps: DataFrame, met: DataFrame, least: float, shingle: int) -> DataFrame:
    """``(src, dst)``: links of Jaccard similarity ``least`` or more that span each bucket of ``met`` (``_key``, ``_pid``).

    Thinning comes after the exact check: of a bucket only pairs that verified
    links have joined already are left out.  ``docs`` has ``_id`` and ``_text``.
    """
    # Buckets with the same members say the same; one of them is enough.
    full = (
        met.groupBy("_key")
        .agg(
            F.count("*").alias("_n"),
            F.sum(F.xxhash64("_pid").cast("decimal(20,0)")).alias("_s"),
            F.min("_pid").alias("_least"),
        )
        .where("_n > 1")
        .groupBy("_n", "_s", "_least")
        .agg(F.min("_key").alias("_key"))
        .select("_key")
    )
    members = settle(met.join(full, "_key", "left_semi"), "near-members")
    needed = reps.join(members.select("_pid").distinct(), "_pid", "left_semi").select("_pid", "_digest", F.col("_rep").alias("_id"))
    bodies = settle(
        docs.join(needed, "_id")
        .select("_pid", "_digest", "_text")
        .mapInArrow(_bodies, "_pid long, _text binary")
        .dropDuplicates(["_pid"]),
        "near-texts",
    )
    return (
        members.join(bodies, "_pid")
        .select("_key", "_pid", "_text")
        .repartition(F.col("_key"))
        .sortWithinPartitions("_key", "_pid")
        .mapInArrow(_verify(least, shingle), "src long, dst long")
        .distinct()
    )


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 5,
    wide: int = 13,
    least: float = 0.8,
    shingle: int = 5,
) -> DataFrame:
    """``(node, component, text_hash, kept)`` for documents that have near copies of similarity ``least`` or more.

    ``text_hash`` is Spark's ``xxhash64`` of the text and tells the texts of a
    repeated id apart; ``kept`` marks the one document that stays.

    Candidates come from two sources.  Ten three-row MinHash bands over the
    ``shingle``-word runs find a pair at ``least`` with probability 0.999 or
    more, whatever the length of the texts.  Ball hashing, on halves, of the
    fingerprint of distinct word pairs, which one changed word moves by
    little, adds pairs within ``radius`` that agree to ``wide`` bits on the
    4-word fingerprint; of these only pairs that the bands have not joined are
    looked at.  Members of a bucket are verified by exact Jaccard similarity,
    and verified links are joined into components, named by the smallest id.

    Defined cases: rows with a null id take no part; texts of equal words are
    one text, null and wordless ones too; an id with several texts is judged
    for each of them and may have several rows.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = settle(
        texts.select("_id", "_text", F.xxhash64("_text").alias("_hash")).mapInArrow(
            _two_fingerprints(least, shingle), "_id long, _hash long, _fp long, _check long, _digest binary, _bands array<long>"
        ),
        "near",
    )
    reps = settle(
        rows.groupBy("_digest", "_fp", "_check", "_bands").agg(F.min("_id").alias("_rep")).withColumn("_pid", F.monotonically_increasing_id()),
        "near-distinct",
    )
    banded = settle(reps.select(F.explode("_bands").alias("_key"), "_pid"), "near-bands")
    joined = settle(_verified(texts, reps, banded, least, shingle), "near-links")
    groups = connected_components(joined, "near-cc").withColumnRenamed("node", "_pid")
    labelled = reps.join(groups, "_pid", "left").select("_pid", "_fp", "_check", F.coalesce("component", "_pid").alias("_comp"))
    keys = [
        h.bitwiseXOR(F.lit(m)).bitwiseOR(F.lit(side << 32))
        for h, side in ((F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF)), 0), (F.shiftrightunsigned("_fp", 32), 1))
        for m in (0, *(1 << i for i in range(32)))
    ]
    met = settle(
        labelled.select(F.explode(F.array(*keys)).alias("_key"), "_fp", "_check", "_comp", "_pid")
        .repartition(F.col("_key"))
        .sortWithinPartitions("_key")
        .mapInArrow(_candidates(radius, wide), "_key long, _pid long"),
        "near-met",
    )
    comp = connected_components(joined.unionByName(_verified(texts, reps, met, least, shingle)), "near-cc")
    named = reps.join(comp, reps["_pid"] == comp["node"], "left").select("_digest", F.coalesce("component", "_pid").alias("_group"))
    found = settle(rows.select("_id", "_hash", "_digest").join(named, "_digest").select(F.struct("_id", "_hash").alias("_row"), "_group"), "near-groups")
    first = settle(
        found.groupBy("_group").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last")).where("_first <> _last").drop("_last"),
        "near-first",
    )
    return (
        found.join(first, "_group")
        .select(
            F.col("_row._id").alias("node"),
            F.col("_first._id").alias("component"),
            F.col("_row._hash").alias("text_hash"),
            (F.col("_row") == F.col("_first")).alias("kept"),
        )
        .distinct()
    )
