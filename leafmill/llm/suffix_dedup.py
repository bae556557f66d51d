"""Substring deduplication by suffix arrays built with two-stage sorting.

A byte goes if a 100-byte string that covers it also starts earlier in the
corpus.  To bring equal strings together without sorting the whole corpus as
one array, every 100-byte string is filed under the 32-byte gram with the
least hash inside it: equal strings have equal grams.  Neighbouring strings
that share a gram make one segment.  First only hashes and places of segments
travel; those whose gram occurs once cannot repeat and end there.  Then the
texts of the other segments travel, compressed, and documents are never joined
with each other.

Arrived segments are cut into blocks of whole grams; each block gets a suffix
array by two-stage sorting: suffixes smaller than their successor are sorted
directly, the others are induced from them by scanning the buckets of their
first byte.  Common prefixes of neighbours in the array show the equal
strings; all but the earliest are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 32
#: Bytes of text scanned at a time; positions inside a scan take 20 bits.
SCAN = 1 << 20
#: Bytes of text whose segments are sent together.
FLUSH = 4 << 20
#: Bytes of segments that a suffix array spans, unless one gram has more.
BLOCK = 1 << 20
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ``GRAM``-byte gram of a byte array."""
    n = len(buf) - GRAM + 1
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    h = words[:n] * _MIX1
    for at in (8, 16, 24):
        h ^= h >> np.uint64(29)
        h += words[at : at + n]
        h *= _MIX2
    h ^= h >> np.uint64(32)
    h *= _MIX1
    h ^= h >> np.uint64(31)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(blocks, w)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def segments(buf: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the strings of ``span`` bytes in ``buf``: gram hash, first and last start.

    ``ends`` has the end of each text in ``buf``; no string crosses one.
    """
    none = np.zeros(0, np.int64)
    if len(buf) < span:
        return np.zeros(0, np.uint64), none, none
    h = _gram_hashes(buf)
    low = np.uint64((1 << 20) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    least = _window_min(packed, span - GRAM + 1)
    valid = np.zeros(len(least) + 1, np.int8)
    starts = np.r_[0, ends[:-1]]
    fits = ends - starts >= span
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, ends[fits] - span + 1, -1)
    ok = np.cumsum(valid[:-1]).astype(bool)
    change = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])])
    change = np.union1d(change, starts[fits])
    change = change[change < len(least)]
    stop = np.r_[change[1:], len(least)] - 1
    own = ok[change]
    first, last = change[own], stop[own]
    return h[(least[first] & low).astype(np.int64)], first, last


def _gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    if not len(start):
        return buf[:0]
    step = np.ones(int(length.sum()), np.int32)
    at = np.cumsum(length) - length
    step[at] = np.r_[start[0], start[1:] - (start[:-1] + length[:-1] - 1)]
    return buf[np.cumsum(step)]


def two_stage_suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` that ``wanted`` marks, ordered by their first ``depth`` bytes.

    ``text`` must end with ``depth`` or more zero bytes that no wanted suffix starts in.
    Suffixes smaller than their successor are sorted directly.  A larger one
    follows its successor's place: buckets of the first byte are scanned in
    order, and each suffix met appends its predecessor, if that is larger, to
    the predecessor's bucket.  A larger suffix needs its successor in the
    array, so marks are first extended to the next directly sorted suffix.
    """
    n = len(text)
    # smaller[i]: suffix i < suffix i+1; runs of one byte take the kind of their end.
    differs = np.flatnonzero(text[:-1] != text[1:])
    runs = np.searchsorted(differs, np.arange(n - 1))
    inside = runs < len(differs)
    edge = differs[np.minimum(runs, len(differs) - 1)] if len(differs) else np.zeros(n - 1, np.int64)
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.where(inside, text[edge] < text[np.minimum(edge + 1, n - 1)], True) if len(differs) else True
    smaller[-1] = True
    need = wanted.copy()
    # The next directly sorted suffix after each wanted larger one, and all between.
    larger = ~smaller
    nxt = np.where(smaller, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    ask = np.flatnonzero(wanted & larger)
    if len(ask):
        reach = np.zeros(n + 1, np.int32)
        np.add.at(reach, ask, 1)
        np.add.at(reach, np.minimum(nxt[ask] + 1, n), -1)
        need |= np.cumsum(reach[:-1]) > 0
    direct = np.flatnonzero(need & smaller)
    direct = direct[direct + depth <= n] if n else direct
    grid = np.lib.stride_tricks.sliding_window_view(text, depth)
    keys = np.ascontiguousarray(grid[direct]).view(f"S{depth}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    head = text[direct]
    bounds = np.searchsorted(head, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    may = need & larger
    for c in range(256):
        # Larger suffixes of a bucket precede the directly sorted ones.
        found = np.concatenate(pending[c]) if pending[c] else direct[:0]
        waves = [found]
        while len(found):
            before = found[found > 0] - 1
            before = before[may[before]]
            kinds = text[before]
            same = before[kinds == c]
            _append(pending, before[kinds != c], text)
            if len(same):
                waves.append(same)
            found = same
        sorted_here = direct[bounds[c] : bounds[c + 1]]
        out += [*waves, sorted_here]
        before = sorted_here[sorted_here > 0] - 1
        _append(pending, before[may[before]], text)
    order = np.concatenate(out) if out else direct[:0]
    return order[wanted[order]]


def _append(pending: list[list[np.ndarray]], found: np.ndarray, text: np.ndarray) -> None:
    if len(found):
        kinds = text[found]
        by = np.argsort(kinds, kind="stable")
        found, kinds = found[by], kinds[by]
        cuts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)], strict=True):
            pending[int(kinds[a])].append(found[a:b])


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, at most ``depth``."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    grid = np.lib.stride_tricks.sliding_window_view(text, depth)
    for at in range(1, len(order), 65_536):
        b = np.arange(at, min(at + 65_536, len(order)))
        differs = grid[order[b]] != grid[order[b - 1]]
        first = differs.argmax(axis=1)
        out[b] = np.where(differs[np.arange(len(b)), first], first, depth)
    return out


def later_copies(text: np.ndarray, wanted: np.ndarray, doc: np.ndarray, pos: np.ndarray, span: int) -> np.ndarray:
    """Wanted starts whose ``span`` bytes also start earlier by ``(doc, pos)``.

    ``doc`` and ``pos`` belong to every byte of ``text``.
    """
    order = two_stage_suffix_array(text, wanted, span)
    fresh = common_prefixes(text, order, span) < span
    group = np.cumsum(fresh) - 1
    d, p = doc[order], pos[order]
    by = np.lexsort((p, d, group))
    first = np.r_[True, group[by][1:] != group[by][:-1]]
    # Copies of the same start (from repeated segments) are all earliest.
    head = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    later = (d[by] != d[head]) | (p[by] != p[head])
    return order[by[later]]


def _runs(doc: np.ndarray, pos: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered bytes ``(doc, start, end)`` of string starts."""
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + span)]) if len(doc) else np.zeros(0, int)
    ends = np.r_[cut[1:], len(doc)] - 1 if len(doc) else cut
    return doc[cut], pos[cut], pos[ends] + span


def _scanned(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple]:
    """Segments of about ``FLUSH`` bytes of text at a time: gram hash, document, start, length."""
    texts: list[bytes] = []
    marks: list[tuple[int, int]] = []  # document, and where the part starts in it
    held, scanned, pieces = 0, 0, []

    def scan():
        nonlocal texts, marks, held, scanned
        if texts:
            buf = np.frombuffer(b"".join(texts), np.uint8)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(size)
            h, first, last = segments(buf, ends, span)
            which = np.searchsorted(ends, first, side="right")
            docs = np.array([m[0] for m in marks], np.int64)
            shift = np.array([m[1] for m in marks], np.int64) - (ends - size)
            pieces.append((h, docs[which], first + shift[which], last - first + span))
            scanned += len(buf)
        texts, marks, held = [], [], 0

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            body = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(body) < span or doc is None:
                continue
            # A very long text is scanned in parts that overlap by one string less a byte.
            for at in range(0, max(1, len(body) - span + 1), SCAN // 2):
                part = body[at : at + SCAN // 2 + span - 1]
                if held + len(part) > SCAN - 1:
                    scan()
                texts.append(part)
                marks.append((doc, at))
                held += len(part)
                if scanned + held >= FLUSH:
                    scan()
                    yield tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
                    pieces, scanned = [], 0
    scan()
    if pieces:
        yield tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its elements, in order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _blobs(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["_bucket", "_blob"]
    )


#: The document of a notice; this one id cannot be told from it.
NOTICE = np.iinfo(np.int64).min


def _announce(span: int, buckets: int):
    """Texts to hashes and places of their segments, by bucket.

    A gram met twice in one flush is known to repeat: all its segments are
    named at once (bucket below zero), and one notice without a document tells
    its bucket.  So a gram shared by many documents sends one entry a flush.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for h, doc, start, length in _scanned(batches, span):
            by = np.argsort(h, kind="stable")
            same = h[by][1:] == h[by][:-1]
            twin = np.zeros(len(h), bool)
            twin[by[1:]] |= same
            twin[by[:-1]] |= same
            first = np.zeros(len(h), bool)
            first[by[np.r_[True, ~same]]] = True
            sent = np.flatnonzero(~twin | first)
            owner = np.where(twin, NOTICE, doc)
            bucket = ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            out = []
            for key, i in _by_bucket(bucket[sent]):
                i = sent[i]
                out.append((key, z.compress(_packed(h[i], owner[i], start[i], length[i]))))
            known = np.flatnonzero(twin)
            for key, i in _by_bucket(doc[known] % buckets):
                i = known[i]
                out.append((-1 - key, z.compress(_packed(h[i], doc[i], start[i], length[i]))))
            yield _blobs(out)

    return run


def _packed(h, doc, start, length, text=b"") -> bytes:
    """One column after the other; documents and starts as differences, which compress."""
    d = np.diff(doc, prepend=np.int64(0))
    return b"".join(
        (np.array([len(h)], "<i8").tobytes(), h.astype("<u8").tobytes(), d.astype("<i8").tobytes(), start.astype("<i8").tobytes(), length.astype("<u4").tobytes(), text)
    )


def _unpacked(raw: bytes) -> tuple:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    h = np.frombuffer(raw, "<u8", n, 8)
    doc = np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 8 * n))
    start = np.frombuffer(raw, "<i8", n, 8 + 16 * n)
    length = np.frombuffer(raw, "<u4", n, 8 + 24 * n).astype(np.int64)
    return h, doc, start, length, np.frombuffer(raw, np.uint8, offset=8 + 28 * n)


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Announced segments whose gram occurs again; rows come sorted by bucket."""
    z = zstandard.ZstdDecompressor()

    def out(h, doc, start, length):
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(h.view(np.int64)), pa.array(start), pa.array(length.astype(np.int32))],
            names=["_id", "_gram", "_start", "_length"],
        )

    def settled(parts):
        h, doc, start, length = (np.concatenate([p[k] for p in parts]) for k in range(4))
        by = np.argsort(h, kind="stable")
        same = h[by][1:] == h[by][:-1]
        twin = np.zeros(len(h), bool)
        twin[by[1:]] |= same
        twin[by[:-1]] |= same
        named = twin & (doc != NOTICE)
        return out(h[named], doc[named], start[named], length[named])

    bucket, parts = None, []
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = _unpacked(z.decompress(blob.as_buffer()))[:4]
            if key < 0:
                yield out(*found)
                continue
            if key != bucket:
                if parts:
                    yield settled(parts)
                bucket, parts = key, []
            parts.append(found)
    if parts:
        yield settled(parts)


def _send(span: int, buckets: int):
    """Texts with their named segments to packed segments by bucket.

    Equal segments within a flush are settled at once: only the earliest
    travels, the others are covered whole (bucket below zero).
    """

    def flush(texts, marks, z):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts[:-1])])
        count = [len(m[1]) for m in marks]
        doc = np.repeat(np.array([m[0] for m in marks], np.int64), count)
        h, start, length = (np.concatenate([m[k] for m in marks]) for k in (1, 2, 3))
        base = np.repeat(at, count) + start
        by = np.lexsort((start, doc, h))
        same = h[by][1:] == h[by][:-1]
        again = by[np.r_[False, same] | np.r_[same, False]]
        gone = np.zeros(len(h), bool)
        seen: set[tuple[int, bytes]] = set()
        for i in again.tolist():
            key = (int(h[i]), buf[base[i] : base[i] + length[i]].tobytes())
            if key in seen:
                gone[i] = True
            seen.add(key)
        out = []
        dropped = np.flatnonzero(gone)
        for key, i in _by_bucket(doc[dropped] % buckets):
            i = dropped[i]
            out.append((-1 - key, z.compress(_packed(h[i], doc[i], start[i], length[i]))))
        kept = np.flatnonzero(~gone)
        for key, i in _by_bucket(((h[kept] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)):
            i = kept[i]
            text = _gather(buf, base[i], length[i]).tobytes()
            out.append((key, z.compress(_packed(h[i], doc[i], start[i], length[i], text))))
        return _blobs(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        texts, marks, held = [], [], 0
        for b in batches:
            for doc, text, named in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if not named.is_valid:
                    continue
                rows = named.values
                h, start, length = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                texts.append(text.as_buffer().to_pybytes())
                marks.append((doc, h.view(np.uint64), start, length.astype(np.int64)))
                held += int(length.sum()) // 3 + 1
                if held >= FLUSH:
                    yield flush(texts, marks, z)
                    texts, marks, held = [], [], 0
        if texts:
            yield flush(texts, marks, z)

    return run


def _judge(span: int):
    """Packed segments of a bucket to runs of removed bytes."""

    def block(h, doc, origin, length, place, body):
        """Later copies among whole grams; arrays are sorted by gram."""
        text = np.concatenate([_gather(body, place, length), np.zeros(span, np.uint8)])
        ends = np.cumsum(length)
        begins = ends - length
        wanted = np.zeros(len(text), bool)
        starts = _gather(np.arange(len(text), dtype=np.int64), begins, length - span + 1)
        wanted[starts] = True
        owner = np.repeat(np.arange(len(length)), length)
        owner = np.r_[owner, np.zeros(span, owner.dtype)]
        d = doc[owner]
        p = origin[owner] + np.arange(len(text)) - begins[owner]
        later = later_copies(text, wanted, d, p, span)
        return _runs(d[later], p[later], span)

    def judged(parts):
        heads = [np.concatenate([p[k] for p in parts]) for k in range(4)]
        h, doc, origin, length = heads
        body = np.concatenate([p[4] for p in parts])
        place = np.cumsum(length) - length
        by = np.argsort(h, kind="stable")
        hs = h[by]
        twin = np.zeros(len(hs), bool)
        same = hs[1:] == hs[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        by = by[twin]
        if not len(by):
            return
        hs, lens = h[by], length[by]
        new = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        upto = np.cumsum(lens)
        a = 0
        for k, at in enumerate([*new[1:].tolist(), len(by)]):
            if upto[at - 1] - (upto[a] - lens[a]) >= BLOCK or at == len(by):
                i = by[a:at]
                yield block(h[i], doc[i], origin[i], length[i], place[i], body)
                a = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        out = lambda d, a, b: pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (d, a, b)], names=["_id", "_from", "_to"]
        )
        bucket, parts = None, []
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = _unpacked(z.decompress(blob.as_buffer()))
                if key < 0:
                    yield out(found[1], found[2], found[2] + found[3])
                    continue
                if key != bucket:
                    if parts:
                        for runs in judged(parts):
                            yield out(*runs)
                    bucket, parts = key, []
                parts.append(found)
        if parts:
            for found in judged(parts):
                yield out(*found)

    return run


def _apply():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[], [], [], [], []]
            for text, runs in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                spans: list[list[int]] = []
                for a, e in sorted((r["_from"], r["_to"]) for r in runs or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([a, e])
                digest, at = hashlib.sha256(), 0
                for a, e in spans:
                    digest.update(body[at:a])
                    at = e
                digest.update(body[at:])
                for c, v in zip(cols, (len(body), sum(e - a for a, e in spans), len(spans), digest.hexdigest(), [{"start": a, "end": e} for a, e in spans]), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *[pa.array(c, pa.int64()) for c in cols[:3]],
                    pa.array(cols[3], pa.string()),
                    pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def removed_runs(texts: DataFrame, span: int, bucket_bytes: int) -> DataFrame:
    """``(_id, _from, _to)``: byte ranges, possibly overlapping, that are covered by later copies.

    ``texts`` is ``(_id, _text)``.
    """
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    # A segment takes 28 bytes a 35 bytes of text in the first exchange and four bytes a byte in the second.
    first, second = max(1, -(-total // bucket_bytes)), max(1, -(-4 * total // bucket_bytes))
    named = (
        texts.mapInArrow(_announce(span, first), "_bucket long, _blob binary")
        .repartition(max(1, -(-first // 2)), "_bucket")
        .sortWithinPartitions("_bucket")
        .mapInArrow(_repeating, "_id long, _gram long, _start long, _length int")
        .groupBy("_id")
        .agg(F.collect_list(F.struct("_gram", "_start", "_length")).alias("_named"))
    )
    return (
        texts.join(named.hint("shuffle_hash"), "_id", "left")
        .mapInArrow(_send(span, second), "_bucket long, _blob binary")
        .repartition(max(1, -(-second // 2)), "_bucket")
        .sortWithinPartitions("_bucket")
        .mapInArrow(_judge(span), "_id long, _from long, _to long")
    )


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = 100,
    bucket_bytes: int = 24 << 20,
) -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, n_spans, kept_sha256, spans)``, one row per input row.

    A byte is removed if a string of ``span`` bytes that covers it also starts
    earlier: in a smaller id, or earlier in the same document.  Strings are
    judged on the input and never cross documents.  ``spans`` are the maximal
    removed byte ranges.

    Defined cases: a null text is empty; texts shorter than ``span`` keep all
    bytes; a row with a null id is neither changed nor a source of copies;
    rows that repeat an id are one document and must hold one text; an empty
    table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    runs = (
        removed_runs(texts, span, bucket_bytes)
        .groupBy("_id")
        .agg(F.collect_set(F.struct("_from", "_to")).alias("_runs"))
    )
    return (
        # The same exchange of texts serves both joins.
        texts.join(runs.hint("shuffle_hash"), "_id", "left")
        .mapInArrow(
            _apply(),
            f"_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>",
        )
        .withColumn("_id", F.col("_id").cast(kind))
        .withColumnRenamed("_id", id_col)
    )
