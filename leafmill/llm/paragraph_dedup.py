"""Substring deduplication of paragraphs by MinHash banding.

A repeated passage seldom begins and ends where lines do, so the paragraphs
compared here are cut by content.  Of every ``window`` consecutive five-word
runs of a text the one with the least hash is an anchor, and a paragraph is
the ``length`` words from an anchor on, across line ends.  Anchors depend on
nothing but the words around them, so a passage of ``window + length`` words
holds the same whole paragraph wherever it stands (all but surely: of two
neighbouring anchors one gives way).  Paragraphs overlap.
The first and the last ``length`` words of a text are paragraphs too, and so is
a whole text of fewer words.

Where two paragraphs stand apart, words between them would never be looked at.
With ``cover`` such a gap is filled by further paragraphs, evenly spaced from
one anchor to the next and so as content-defined as these, and every word of
every text lies in a paragraph.

Equal paragraphs (words lower-cased in A-Z and joined by one space) are one
text; the texts' five-word shingles are minhashed and banded.  Texts that
share a band bucket are verified by exact Jaccard similarity, verified links
are joined into components, and of each component only the earliest paragraph
stays.

``tune_bands`` picks the fewest bands that still find a pair at the threshold
with the wanted recall.  Paragraphs of 20 words at 0.8 differ in one five-word
shingle at most, which can only lie at an end, so their runs of ten words have
a similarity of 10/12 at least, while a changed word in the middle leaves no
run: those runs are minhashed, in bands of one row.  Shorter texts are banded
by their five-word shingles, in bands of two rows; texts of ``RUNS_FROM`` words
or more that are shorter than a paragraph get both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, forget, pick_rows, release, settle

SHINGLE = 5
#: Words of a text that are looked at together; very long texts are taken in such slabs, which overlap.
SLAB = 100_000
#: Paragraphs that start this many words apart share 0.8 of their shingles.
APART = 1
#: Words of the runs by which whole paragraphs are banded, and the least similarity of those runs.
RUN, RUN_LEAST = 10, 10 / 12
#: Words from which on a text is banded by runs.
RUNS_FROM = 17
#: 96 bits of a paragraph's XXH3.
DIGEST = ["_digest", "_more"]


def tune_bands(threshold: float, recall: float = 0.999, rows: int = 2) -> tuple[int, int]:
    """Bands and rows that collide a pair at ``threshold`` with probability ``recall`` or more."""
    miss = 1 - threshold**rows
    bands = 1
    while 1 - miss**bands < recall:
        bands += 1
    return bands, rows


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``k`` words; fewer words are one shingle."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1)
    k = min(k, len(words))
    starts = (ends - size - 1)[: len(words) - k + 1].tolist()
    # Chained maps: no Python frame runs for a shingle.
    runs = map(joined.__getitem__, map(slice, starts, (ends[k - 1 :] - 1).tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(starts))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[frozenset[int]]:
    """Sets of the shingle hashes of many texts of words joined by one space, hashed in one go."""
    count = [t.count(b" ") + 1 for t in texts]
    every = shingle_hashes(b" ".join(texts).split(b" "), k).tolist()
    out, at = [], 0
    for text, n in zip(texts, count, strict=True):
        # Shingles that reach into the next text are left out.
        out.append(frozenset(every[at : at + n - k + 1] if n >= k else shingle_hashes(text.split(b" "), k).tolist()))
        at += n
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(bands: int, rows: int, seed: int):
    """A function from non-empty hash arrays (a list, or the rows of a matrix) to a list column of their band keys."""
    rng = np.random.default_rng(seed)
    mults = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    adds = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(hashes: list[np.ndarray] | np.ndarray) -> pa.ListArray:
        n = len(hashes)
        even = isinstance(hashes, np.ndarray)
        at = np.arange(n + 1) * hashes.shape[1] if even else np.cumsum([0, *map(len, hashes)])
        flat = hashes.ravel() if even else np.concatenate(hashes)
        sig = np.empty((n, bands), np.uint64)
        for b in range(bands):
            value = np.full(n, b, np.uint64)
            for r in range(b * rows, b * rows + rows):
                mixed = flat * mults[r] + adds[r]
                mixed ^= mixed >> np.uint64(32)
                low = np.minimum.reduceat(mixed, at[:-1])
                value = (value ^ low) * np.uint64(0x9E3779B97F4A7C15)
                value ^= value >> np.uint64(29)
            sig[:, b] = value
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(sig.view(np.int64).ravel()))

    return keys


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of every ``window`` consecutive hashes, the first of equal ones.

    Where one hash comes again and again, as in a text of one repeated word,
    only one of its places in ``window`` counts.  Of places within ``APART``
    the one with the least hash counts, as paragraphs so close would be near
    copies of each other.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    w = min(window, len(hashes))
    found = np.unique(np.lib.stride_tricks.sliding_window_view(hashes, w).argmin(axis=1) + np.arange(len(hashes) - w + 1))
    again = np.r_[False, (hashes[found[1:]] == hashes[found[:-1]]) & (np.diff(found) < window)]
    if again.any():
        since = found - found[np.maximum.accumulate(np.where(again, 0, np.arange(len(found))))]
        found = found[~again | (since // window != np.r_[0, since[:-1]] // window)]
    gone = np.zeros(len(found), bool)
    for step in range(1, min(APART + 1, len(found))):  # each place and the `step`-th next one
        near = found[step:] - found[:-step] <= APART
        less = hashes[found[:-step]] <= hashes[found[step:]]
        gone[step:] |= near & less
        gone[:-step] |= near & ~less
    return found[~gone]


def fill(places: np.ndarray, length: int) -> np.ndarray:
    """The places with the fewest others between them that leave no step above ``length``, evenly spaced."""
    gap = np.diff(places)
    more = (gap - 1) // length
    by = np.repeat(np.arange(len(gap)), more)
    nth = np.arange(1, len(by) + 1) - (np.cumsum(more) - more)[by]
    return np.sort(np.concatenate([places, places[by] + gap[by] * nth // (more[by] + 1)]))


def cut(text: bytes, window: int, length: int, cover: bool = False) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The paragraphs of a lower-cased text, slab by slab.

    Gives the slab's words joined by one space; of each paragraph the first
    word in the slab, and its start and end among those joined words and in the
    text, in bytes; and the hashes of the slab's shingles.  With ``cover``
    every word lies in a paragraph: gaps are filled, and a paragraph that
    leaves out ``APART`` words or fewer at an end of the text takes them in.
    """
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return
    # Two paragraphs of a text hardly longer than one would be near copies of each other, so it is one.
    length = n if n <= length + (APART if cover else 0) else length
    # Anchors from `done` on are still to come; slabs overlap by what an anchor and its paragraph can see.
    done, margin = 0, 2 * window + length + SHINGLE
    for first in range(0, n, SLAB):
        a, b = max(0, min(first, done) - margin), min(n, first + SLAB + margin)
        words = text[starts[a] : ends[b - 1]].split()
        joined = b" ".join(words)
        h = shingle_hashes(words)
        found = anchors(h, window) if n > length else np.zeros(1, np.int64)
        if cover:
            # The text ends before what begins here does.
            found = found[found + a + length <= n]
        ends_of_text = [k for k in (-a, n - length - a) if not (np.abs(found - k) <= APART).any()]
        found = np.unique(np.concatenate([found, np.array(ends_of_text, np.int64)]))
        found = found[(found + a >= done) & (found + a < first + SLAB) & (found + a + length <= n)]
        if not len(found):
            continue
        if cover:
            # From the last place of the slab before on.
            found = fill(np.r_[done - 1 - a, found], length)[1:] if done else fill(found, length)
        done = int(found[-1]) + a + 1
        size = ends[a:b] - starts[a:b]
        upto = np.cumsum(size + 1)
        head, last = found, found + length - 1
        if cover:
            head, last = np.where(found + a <= APART, -a, head), np.where(last + a >= n - 1 - APART, n - 1 - a, last)
        yield joined, found, np.stack([upto[head] - size[head] - 1, upto[last] - 1]), starts[a + head], ends[a + last], h


def _keys(least: float, recall: float, length: int, seed: int):
    """Names of the band columns, and a function that gives them for the paragraphs of a slab (null where one has no such band)."""
    long_bands, short_bands = tune_bands(RUN_LEAST, recall, 1), tune_bands(least, recall, 2)
    by_runs, by_shingles = band_keys(*long_bands, seed), band_keys(*short_bands, seed + 1)
    n = long_bands[0] + short_bands[0]

    def of(found: np.ndarray, words: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, has = np.zeros((len(found), n), np.int64), np.zeros(n, bool)
        if words >= RUNS_FROM:
            runs = h[: len(h) - SHINGLE] * np.uint64(0x9E3779B97F4A7C15) ^ h[SHINGLE:]
            place = found[:, None] + np.arange(words - RUN + 1)[None, :]
            out[:, : long_bands[0]] = by_runs(runs[place]).values.to_numpy().reshape(len(found), -1)
            has[: long_bands[0]] = True
        if words < length:
            out[:, long_bands[0] :] = by_shingles(h[None, :]).values.to_numpy().reshape(len(found), -1)
            has[long_bands[0] :] = True
        return out, np.broadcast_to(has, out.shape)

    return [f"_b{k}" for k in range(n)], of


def _paragraphs(names: list[str], keys, window: int, length: int, cover: bool):
    """Paragraphs with their bands and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        kind = np.dtype([("most", "<i8"), ("more", "<i4"), ("rest", "<i4")])

        def out(parts, bodies):
            ids, lines, starts, sizes, words, keys, has = (np.concatenate(c) for c in zip(*parts, strict=True))
            digests = np.frombuffer(b"".join(map(digest, bodies)), kind)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids),
                    pa.array(lines.astype(np.int32)),
                    pa.array(starts),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(words.astype(np.int32)),
                    pa.array(digests["most"].copy()),
                    pa.array(digests["more"].copy()),
                    pa.array(bodies, pa.binary()),
                    *[pa.array(keys[:, k], mask=~has[:, k]) for k in range(len(names))],
                ],
                names=["_id", "_par", "_start", "_length", "_words", *DIGEST, "_text", *names],
            )

        parts, bodies = [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                body = text.as_buffer().to_pybytes().lower()
                lines = np.flatnonzero(np.frombuffer(body, np.uint8) == 10)
                for joined, found, place, start, end, h in cut(body, window, length, cover):
                    n, words = len(found), joined.count(b" ") + 1
                    # What a paragraph takes in at an end of the text does not enter its bands.
                    words = words if words <= length + (APART if cover else 0) else length
                    new = [joined[a:b] for a, b in zip(*place.tolist(), strict=True)]
                    bodies += new
                    parts.append((np.full(n, doc), np.searchsorted(lines, start), start, end - start, np.array([t.count(b" ") + 1 for t in new]), *keys(found, words, h)))
                if len(bodies) > 10_000:
                    yield out(parts, bodies)
                    parts, bodies = [], []
        if parts:
            yield out(parts, bodies)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key occurs again; rows come sorted by key."""

    def out(k, p):
        same = k[1:] == k[:-1]
        hit = (np.r_[False, same] | np.r_[same, False])[: len(k)]
        return pa.RecordBatch.from_arrays([pa.array(k[hit]), pa.array(p[hit])], names=["_key", "_pid"])

    key = pid = np.zeros(0, np.int64)
    for b in batches:
        key, pid = (np.concatenate([x, c.to_numpy()]) for x, c in ((key, b.column(0)), (pid, b.column(1))))
        if len(key):
            # All but the last key are complete.
            last = int(np.searchsorted(key, key[-1]))
            yield out(key[:last], pid[:last])
            key, pid = key[last:], pid[last:]
    yield out(key, pid)


class _Bucket:
    """Links among the texts of one bucket.

    Jaccard distance is a metric, so texts are gathered under leaders within
    ``near`` and only leaders are compared with each other; members of two
    groups are compared only where their leaders are close enough for a link
    and not linked already.
    """

    def __init__(self, least: float):
        self.far = 1 - least
        self.near = self.far / 2
        self.leaders: list[list] = []
        self.linked: list[tuple[int, int]] = []
        self.up: dict[int, int] = {}

    def _root(self, node: int) -> int:
        while self.up[node] != node:
            self.up[node] = self.up[self.up[node]]
            node = self.up[node]
        return node

    def _unite(self, a: int, b: int) -> None:
        """Keep a link only if it joins what was apart, so a bucket gives fewer links than members."""
        x, y = self._root(a), self._root(b)
        if x != y:
            self.up[y] = x
            self.linked.append((a, b))

    def add(self, node: int, shingles: np.ndarray) -> None:
        self.up[node] = node
        home = None
        for leader in self.leaders:
            if home is not None and self._root(leader[0][0]) == self._root(node):
                continue
            a, b = len(shingles), len(leader[0][1])
            # The distance is at least what the sizes alone force.
            if min(a, b) < (1 - self.far - self.near) * max(a, b):
                continue
            d = 1 - jaccard(shingles, leader[0][1])
            if d <= self.near and home is None:
                home = leader
            if d <= self.far + 1e-12:
                self._unite(leader[0][0], node)
            elif d <= self.far + self.near:
                for other, theirs in leader[1:]:
                    if self._root(other) != self._root(node) and jaccard(shingles, theirs) >= 1 - self.far - 1e-12:
                        self._unite(other, node)
                        break
        if home is not None:
            home.append((node, shingles))
        else:
            self.leaders.append([(node, shingles)])


def _overlap(a: int, b: int, least: float) -> int:
    """Common elements that two sets of these sizes need for a Jaccard similarity of ``least``."""
    return math.ceil(least * (a + b) / (1 + least) - 1e-9)


def close_sets(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (of positions) that span the groups of similar sets, without comparing all pairs.

    Sets of equal size that may differ in one element meet in what is left
    without it, so equal "all but one" sums find them.  Sets of unequal sizes,
    and sets that may differ in more, are compared with each other.
    """
    up = list(range(len(sets)))
    links = []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def unite(i, j):
        x, y = root(i), root(j)
        if x != y and jaccard(sets[i], sets[j]) >= least - 1e-12:
            up[y] = x
            links.append((i, j))

    groups: dict[int, list[int]] = {}
    for i, x in enumerate(sets):
        groups.setdefault(len(x), []).append(i)
    tables = {}
    for n, own in groups.items():
        table = tables[n] = np.stack([sets[i] for i in own])
        apart = n - _overlap(n, n, least)
        if len(own) > 1 and apart > 1:
            bucket = _Bucket(least)
            for i in own:
                bucket.add(i, sets[i])
            for i, j in bucket.linked:
                unite(i, j)
        elif len(own) > 1:
            mixed = (table ^ (table >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            whole = mixed.sum(axis=1, dtype=np.uint64)[:, None]
            sums = (whole - mixed if apart else whole).ravel()
            owner = np.repeat(np.array(own), sums.size // len(own))
            by = np.argsort(sums, kind="stable")
            same = np.flatnonzero(sums[by][1:] == sums[by][:-1])
            for i, j in np.unique(np.stack([owner[by[same]], owner[by[same + 1]]]), axis=1).T.tolist():
                unite(i, j)
    for a, few in groups.items():
        for b, many in groups.items():
            if a != b and min(a, b) >= least * max(a, b) and (len(few), a) < (len(many), b):
                wanted = _overlap(a, b, least)
                for i in few:
                    for j in np.flatnonzero(np.isin(tables[b], sets[i]).sum(axis=1) >= wanted).tolist():
                        unite(i, many[j])
    return links


def _few_sets(sets: list[frozenset[int]], least: float) -> list[tuple[int, int]]:
    """Links among a few sets, pair by pair, that span their groups."""
    group, links = list(range(len(sets))), []
    for j in range(1, len(sets)):
        for i in range(j):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= _overlap(len(sets[i]), len(sets[j]), least):
                links.append((i, j))
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
    return links


def _verify_paragraphs(least: float):
    """Links of each bucket of paragraphs; rows come sorted by key."""

    def linked(sets):
        if len(sets) <= 6:
            return _few_sets(sets, least)
        return close_sets([np.array(sorted(x), np.uint64) for x in sets], least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, done = None, [], [], []

        def out():
            a = np.array(done, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["src", "dst"])

        for b in batches:
            found = shingle_sets(b.column(2).to_pylist()) if b.num_rows else []
            for k, node, shingles in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found, strict=True):
                if k != key:
                    done += [(nodes[i], nodes[j]) for i, j in linked(sets)]
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(shingles)
            if len(done) > 10_000:
                yield out()
                done = []
        done += [(nodes[i], nodes[j]) for i, j in linked(sets)]
        yield out()

    return run


def _verify(least: float, shingle: int = SHINGLE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket, done = None, None, []

        def out(links):
            a = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["src", "dst"])

        for b in batches:
            for k, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if bucket:
                        done += bucket.linked
                    key, bucket = k, _Bucket(least)
                bucket.add(node, np.unique(shingle_hashes(text.split(), shingle)))
            if len(done) > 10_000:
                yield out(done)
                done = []
        if bucket:
            done += bucket.linked
        yield out(done)

    return run


def paragraph_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    window: int = 30,
    length: int = 20,
    recall: float = 0.97,
    seed: int = 11,
    cover: bool = False,
) -> DataFrame:
    """``(<id_col>, paragraph, start, length, n_words, cluster_doc_id, cluster_start, cluster_size, removed)``.

    One row per paragraph that repeats: equal or at least ``least`` similar,
    directly or over others, to another paragraph.  ``start`` is its first
    byte in the UTF-8 text, ``length`` its bytes, ``paragraph`` the line where
    it starts, counted from 0.  The cluster is named by its earliest
    paragraph, which stays; all others have ``removed`` but those of the same
    text that overlap it.  With ``cover`` every word lies in a paragraph.

    Defined cases: null and wordless texts have no paragraphs; a text of fewer
    than ``length`` words is one paragraph; rows with a null id are not read;
    repeated rows repeat their paragraphs, and of equal ``(id, start)`` rows
    all share one verdict; very long texts are cut in overlapping slabs, which
    gives the same paragraphs; an empty table gives an empty result; other
    columns are not read.
    """
    names, keys = _keys(least, recall, length, seed)
    units = settle(
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
        .mapInArrow(
            _paragraphs(names, keys, window, length, cover),
            "_id long, _par int, _start long, _length int, _words int, _digest long, _more int, _text binary, " + ", ".join(f"{b} long" for b in names),
        )
        .withColumn("_pid", F.monotonically_increasing_id()),
        "paragraphs",
        compression="zstd",
    )
    # One row per text, settled so that the shuffle behind it goes before the next one comes.
    texts = settle(units.groupBy(*DIGEST).agg(F.min("_pid").alias("_pid"), *[F.first(b).alias(b) for b in names]).drop(*DIGEST), "paragraph-texts")
    release(docs.sparkSession)
    banded = settle(
        texts.select(F.explode(F.array_compact(F.array(*names))).alias("_key"), "_pid")
        .repartition(F.col("_key"))
        .sortWithinPartitions("_key")
        .mapInArrow(_met, "_key long, _pid long"),
        "paragraph-bands",
    )
    forget(texts)
    release(docs.sparkSession)
    # Buckets with the same members say the same; one of them is enough.
    full = (
        banded.groupBy("_key")
        .agg(
            F.count("*").alias("_n"),
            F.sum(F.xxhash64("_pid").cast("decimal(20,0)")).alias("_s"),
            F.min("_pid").alias("_least"),
        )
        .groupBy("_n", "_s", "_least")
        .agg(F.min("_key").alias("_key"))
        .select("_key")
    )
    members = settle(banded.join(full, "_key", "left_semi"), "paragraph-members")
    forget(banded)
    release(docs.sparkSession)
    # Only texts that share a bucket travel.
    needed = settle(members.select("_pid").distinct(), "paragraph-needed")
    bodies = settle(pick_rows(units.select("_pid", "_text"), needed, "_pid"), "paragraph-bodies")
    forget(needed)
    release(docs.sparkSession)
    links = settle(
        members.join(bodies, "_pid")
        .select("_key", "_pid", "_text")
        .repartition(F.col("_key"))
        .sortWithinPartitions("_key", "_pid")
        .mapInArrow(_verify_paragraphs(least), "src long, dst long")
        .distinct(),
        "paragraph-links",
    )
    forget(members)
    forget(bodies)
    release(docs.sparkSession)
    comp = connected_components(links, "paragraph-cc")
    grouped = settle(
        units.groupBy(*DIGEST)
        .agg(F.min("_pid").alias("_rep"), F.count("*").alias("_copies"))
        .join(comp, F.col("_rep") == F.col("node"), "left")
        .where("node IS NOT NULL OR _copies > 1")
        .select(*DIGEST, F.coalesce("component", "_rep").alias("_cluster")),
        "paragraph-groups",
    )
    release(docs.sparkSession)
    place = ["_id", "_start"]
    found = settle(
        units.select("_id", "_par", "_start", "_length", "_words", *DIGEST).join(grouped, DIGEST).drop(*DIGEST), "paragraph-clusters"
    )
    forget(units)
    forget(grouped)
    release(docs.sparkSession)
    # Settled, so that the join below is a plain one that can be split where a cluster is hot.
    first = settle(found.groupBy("_cluster").agg(F.min(F.struct(*place, "_length")).alias("_first"), F.count("*").alias("cluster_size")), "paragraph-first")
    return found.join(first, "_cluster").select(
        F.col("_id").alias(id_col),
        F.col("_par").alias("paragraph"),
        F.col("_start").alias("start"),
        F.col("_length").alias("length"),
        F.col("_words").alias("n_words"),
        F.col("_first._id").alias("cluster_doc_id"),
        F.col("_first._start").alias("cluster_start"),
        "cluster_size",
        (~((F.col("_id") == F.col("_first._id")) & (F.col("_start") < F.col("_first._start") + F.col("_first._length")))).alias("removed"),
    )
