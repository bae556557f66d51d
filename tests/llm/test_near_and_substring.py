"""SimHash, suffix arrays and paragraphs against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from leafmill.llm import simhash as sh
from leafmill.llm._shared import connected_components
from leafmill.llm.paragraph_dedup import paragraph_dedup, tune_bands
from leafmill.llm.suffix_dedup import common_prefixes, suffix_dedup, two_stage_suffix_array

DOCS = "doc_id long, text string, component_id string, spans int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS)


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices("abcdefghij", k=40)) for _ in range(30)]
    rows = [(i, base[i % 30]) for i in range(60)]
    for i in range(60, 200):
        words = rng.choice(base).split()
        words[rng.randrange(40)] = "ZZ"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "a " * 20_000), (303, "one")]
    got = {r.doc_id: r for r in sh.simhash_dedup(_docs(spark, rows)).collect()}
    fp = {i: _fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    want = _components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fp
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_of_planted_bits(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    rows, ident = [], 0
    for b in base.tolist():
        for flips in (0, 4, 5, 8):
            v = b
            for k in rng.choice(64, flips, replace=False).tolist():
                v ^= 1 << k
            rows.append((ident, v - (1 << 64) if v >= 1 << 63 else v))
            ident += 1
    groups = {r["_fp"]: r["component_id"] for r in sh.near_groups(spark.createDataFrame(rows, "_id long, _fp long")).collect()}
    ids = [i for i, _ in rows]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    want = _components(ids, [(a, b) for a, x in rows for b, y in rows if a < b and near(x, y)])
    assert all(groups[f] == want[i] for i, f in rows)


@pytest.mark.parametrize("matrix", [4, 2048])
def test_large_buckets_lose_no_link(monkeypatch, matrix):
    monkeypatch.setattr(sh, "MATRIX", matrix)
    monkeypatch.setattr(sh, "SLICE", 50_000)
    rng = np.random.default_rng(3)
    fp = np.unique(np.array([int(x) for x in rng.integers(0, 1 << 12, 150)], np.uint64) << np.uint64(20))
    h, t = sh.bucket_links(np.zeros(len(fp), np.int64), fp, 4)
    got = _components(fp.tolist(), list(zip(h.tolist(), t.tolist(), strict=True)))
    every = [(a, b) for a in fp.tolist() for b in fp.tolist() if a < b and (a ^ b).bit_count() <= 4]
    assert got == _components(fp.tolist(), every)
    if matrix == 4:  # stars of balls join members directly, forests of a matrix over verified chains
        assert all((a ^ b).bit_count() <= 4 for a, b in zip(h.tolist(), t.tolist(), strict=True))


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == _components(ids, [e for e in edges if e[0] != e[1]])


def test_two_stage_suffix_array():
    rng = np.random.default_rng(5)
    for alphabet in (2, 4, 250):
        text = np.r_[rng.integers(1, alphabet + 1, 500), np.zeros(30)].astype(np.uint8)
        wanted = np.zeros(530, bool)
        wanted[: 470] = True
        order = two_stage_suffix_array(text, wanted, 30)
        keys = [text[i : i + 30].tobytes() for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(470))
        lcp = common_prefixes(text, order, 30)
        for k in range(1, 470):
            a, b = keys[k - 1], keys[k]
            assert lcp[k] == next((i for i in range(30) if a[i] != b[i]), 30)


def test_suffix_dedup(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choices("abcdé ", k=n)) for n in (99, 100, 101, 250)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("xyzw", k=120)) for _ in range(4))) for i in range(60, 0, -1)]
    rows += [(100, None), (101, ""), (102, "q" * 5000), (103, passages[3]), (104, passages[3]), (None, passages[3])]
    got = {r.doc_id: r for r in suffix_dedup(_docs(spark, rows)).collect()}
    seen = set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - 99):
            w = body[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(body), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) == len(r.spans)
    assert got[None].n_removed == 0


def test_suffix_dedup_of_negative_ids(spark):
    rng = random.Random(16)
    passage = "".join(rng.choices("abcde ", k=250))
    docs = _docs(spark, [(-5, passage)]).unionByName(_docs(spark, [(-3, passage)]))  # two partitions, two flushes
    assert {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()} == {-5: 0, -3: 250}


def test_nothing_falls_into_no_bucket():
    from leafmill.llm.suffix_dedup import _by_bucket

    assert list(_by_bucket(np.zeros(0, np.int64))) == []
    assert [(k, i.tolist()) for k, i in _by_bucket(np.array([3, 1, 3]))] == [(1, [1]), (3, [0, 2])]


def test_near_copies_are_verified(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=5))
    base, rows = [[word() for _ in range(150)] for _ in range(20)], []
    for k, b in enumerate(base):
        rows.append((k, " ".join(b)))
        few = list(b)
        few[10] = "changed"
        rows.append((100 + k, " ".join(few)))
    rows += [(300, None), (301, ""), (None, rows[0][1])]
    got = {r.node: r.component for r in sh.near_copies(_docs(spark, rows)).collect()}
    assert all(got.get(100 + k) == k for k in range(20) if 100 + k in got)
    assert sum(100 + k in got for k in range(20)) >= 19
    assert got[301] == 300 and set(got) <= {*range(20), *range(100, 120), 300, 301}
    assert sh.near_copies(_docs(spark, [])).count() == 0


def _near_by_brute_force(rows):
    runs = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    return _components(sorted(runs), [(a, b) for a in runs for b in runs if a < b and len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])])


def _group_of_near_copies(rng, n, words, least, most):
    base = ["".join(rng.choices("abcdefghijklm", k=5)) for _ in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(least, most)):
            w[at] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_near_copies_keep_links_that_verify(spark):
    """In a large group of near copies no similar candidate pair is lost to a bit-close pair that is not similar."""
    import pyarrow as pa

    from leafmill.llm.paragraph_dedup import _verify

    rows = _group_of_near_copies(random.Random(4), 301, 400, 2, 8)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(rows)), pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows])], names=["_key", "_pid", "_text"])
    found = [(a, b) for out in _verify(0.8, 5)([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in found)
    assert _components(sorted(sets), found) == _near_by_brute_force(rows)
    # The stage: every candidate pair that is similar ends in one component, whatever else its bucket holds.
    fp = {i: (sh.simhash_of_set(t), sh.simhash(t)) for i, t in rows}
    close = [(a, b) for a in fp for b in fp if a < b and (fp[a][0] ^ fp[b][0]).bit_count() <= 5 and (fp[a][1] ^ fp[b][1]).bit_count() <= 13]
    close = [(a, b) for a, b in close if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.node: r.component for r in sh.near_copies(_docs(spark, rows)).collect()}
    assert all(got[a] == got[b] for a, b in close)


def test_near_copies_find_whole_groups(spark):
    """150 words with two or three changed: one component by brute force, whatever the fingerprints say."""
    rng = random.Random(5)
    rows = _group_of_near_copies(rng, 201, 150, 2, 3)
    for k in range(20):
        # Copies near the limit, whose fingerprints often lie far apart.
        rows += [(1000 + 100 * k + i, t) for i, t in _group_of_near_copies(rng, 3, 200, 2, 4)]
    got = {r.node: r.component for r in sh.near_copies(_docs(spark, rows)).collect()}
    wanted = _near_by_brute_force(rows)
    assert {i: got.get(i, i) for i in wanted} == wanted


def test_tuned_bands_reach_the_recall():
    bands, rows = tune_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def _paragraphs_by_hand(text, window=30, length=20):
    """Starts, ends and words of the paragraphs, one window at a time."""
    body = (text or "").encode().lower()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", body)]
    words = [body[a:b] for a, b in spans]
    n = len(words)
    if n < length:
        return [(spans[0][0], spans[-1][1], words)] if n else []
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(n - 4)]
    w = min(window, len(h))
    at = {min(range(i, i + w), key=lambda k: (h[k], k)) for i in range(len(h) - w + 1)}
    at = {k for k in at if all((h[k], k) <= (h[j], j) for j in range(k - 1, k + 2) if j in at)}
    at |= {k for k in (0, n - length) if not at & set(range(k - 1, k + 2))}
    return [(spans[k][0], spans[k + length - 1][1], words[k : k + length]) for k in sorted(at) if k + length <= n]


def _shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_paragraphs_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lay = lambda words: "".join(w + rng.choice(["  ", " ", " ", "\n", "\t"]) for w in words)
    rows = []
    for i in range(25):
        passage = fresh(51)  # stands within lines, at any place
        rows += [(2 * i, lay(fresh(rng.randrange(200)) + passage + fresh(rng.randrange(200)))), (2 * i + 1, lay(fresh(30) + passage + fresh(rng.randrange(90))))]
    clean = [(100 + i, lay(fresh(150))) for i in range(20)]
    short = fresh(9)
    edited = [*short[:8], "other"]
    rows += clean + [(200, lay(short)), (201, lay(short).upper()), (202, lay(edited)), (203, None), (204, " \n"), (205, "one"), (206, "one"), (206, "one"), (None, lay(short))]
    long = fresh(120)
    rows += [(300, lay(long)), (301, lay(long)), (302, lay([*long[:60], "changed", *long[61:]]))]
    found = paragraph_dedup(_docs(spark, rows)).collect()
    got = {(r.doc_id, r.start): r for r in found}
    units = {(i, a): (b - a, words) for i, t in rows if i is not None for a, b, words in _paragraphs_by_hand(t)}
    sets = {u: _shingle_set(words) for u, (_, words) in units.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    order = sorted(units)
    comp = _components(order, [(a, b) for k, a in enumerate(order) for b in order[:k] if near(a, b)])
    size = collections.Counter(comp.values())
    assert set(got) == {u for u in order if size[comp[u]] > 1}
    for u, r in got.items():
        assert (r.cluster_doc_id, r.cluster_start) == comp[u] and (r.length, r.n_words) == (units[u][0], len(units[u][1]))
        first = comp[u]
        assert r.removed == (u[0] != first[0] or u[1] >= first[1] + units[first][0])
    # Every planted passage of over 50 words is met in both documents, no clean document is.
    assert {r.doc_id for r in found} >= set(range(50)) | {200, 201, 205, 206, 300, 301, 302}
    assert not {r.doc_id for r in found} & ({i for i, _ in clean} | {203, 204, None})
    assert [r.removed for r in found if r.doc_id == 206] == [True, True]


def _covering_by_hand(text, window=30, length=20):
    """Starts, ends and words of paragraphs that leave out no word: anchors, gaps filled, ends taken in."""
    body = (text or "").encode().lower()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", body)]
    words = [body[a:b] for a, b in spans]
    n = len(words)
    if n <= length + 1:
        return [(spans[0][0], spans[-1][1], words)] if n else []
    begins = [s for s, _ in spans]
    at = {k for a, _, _ in _paragraphs_by_hand(text, window, length) for k in [begins.index(a)]}
    at |= {k for k in (0, n - length) if not at & set(range(k - 1, k + 2))}
    at, out = sorted(at), []
    for a, b in zip(at, [*at[1:], None], strict=True):
        parts = 1 if b is None else -(-(b - a) // length)
        out += [a + (0 if b is None else (b - a) * j // parts) for j in range(parts)]
    edges = [(0 if k <= 1 else k, n if k + length >= n - 1 else k + length) for k in out]
    return [(spans[a][0], spans[b - 1][1], words[a:b]) for a, b in edges]


def test_covering_paragraphs_leave_out_no_word(spark, monkeypatch):
    from leafmill.llm import paragraph_dedup as pd

    rng = random.Random(18)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in [*range(1, 90), 300, 1000]]
    texts += [" ".join(rng.choice("abc") for _ in range(500)), "same " * 700, "a b\nc d " * 60, "", " \n"]

    def cut(text):
        return [(a, b, joined[x:y].split()) for joined, _, place, start, end, _ in pd.cut(text.encode(), 30, 20, True) for x, y, a, b in zip(*place, start, end, strict=True)]

    found = [cut(t) for t in texts]
    assert found[:91] == [_covering_by_hand(t) for t in texts[:91]]
    monkeypatch.setattr(pd, "SLAB", 97)
    in_slabs = [cut(t) for t in texts]
    assert in_slabs[:91] == found[:91]
    for text, paragraphs in zip(texts * 2, found + in_slabs, strict=True):
        held = np.zeros(len(text), bool)
        for a, b, words in paragraphs:
            held[a:b] = True
            assert text[a:b].encode().split() == words
        assert all(held[k] for k in range(len(text)) if not text[k].isspace())
    # Of two equal texts every word of the later one goes, by the query's paragraphs.
    rows = [(i, texts[k]) for i, k in enumerate([89, 90, 25, 20, 90, 25, 89, 20])]
    out = collections.defaultdict(list)
    for r in paragraph_dedup(_docs(spark, rows), cover=True).collect():
        out[r.doc_id].append(r)
        assert r.removed == (r.doc_id > 3) and r.cluster_size == 2
    for i, t in rows:
        assert {(r.start, r.length, r.n_words) for r in out[i]} == {(a, b - a, len(w)) for a, b, w in _covering_by_hand(t)}


def test_the_paragraph_query_reads_every_word(spark, tmp_path):
    from leafmill.llm.queries import op1_paragraph_dedup

    rng = random.Random(19)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))
    _docs(spark, [(1, text), (2, text)]).write.parquet(f"{tmp_path}/documents.parquet")
    held = np.zeros(len(text), bool)
    for r in op1_paragraph_dedup(spark, str(tmp_path)).where("removed and doc_id = 2").collect():
        held[r.start : r.start + r.length] = True
    assert all(held[k] for k in range(len(text)) if text[k] != " ")


def test_close_sets_lose_no_link():
    from leafmill.llm.paragraph_dedup import _few_sets, close_sets, shingle_hashes, shingle_sets

    texts = [b"a b c d e f", b"x", b"q w e r", b"a b c d e", b"k l m n o p q r"]
    assert shingle_sets(texts) == [frozenset(shingle_hashes(t.split()).tolist()) for t in texts]

    rng = np.random.default_rng(10)
    base = [rng.choice(1 << 40, 16, replace=False).astype(np.uint64) for _ in range(4)]
    sets = []
    for _ in range(250):
        x = base[rng.integers(4)].copy()
        x[rng.integers(16, size=rng.integers(0, 3))] = rng.integers(1 << 40, dtype=np.uint64)
        sets.append(np.unique(x[: rng.choice([16, 16, 16, 15, 14, 13])]))
    sets += [np.arange(40, dtype=np.uint64), np.arange(4, 44, dtype=np.uint64), np.arange(9, 49, dtype=np.uint64), np.zeros(1, np.uint64)]
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    ids = range(len(sets))
    want = _components(ids, [(i, j) for j in ids for i in range(j) if near(sets[i], sets[j])])
    few = _few_sets([frozenset(x.tolist()) for x in sets], 0.8)
    assert _components(ids, few) == want and len(few) < len(sets)
    got = close_sets(sets, 0.8)
    assert _components(ids, got) == want and len(got) < len(sets)


def test_slabs_do_not_change_paragraphs(monkeypatch):
    from leafmill.llm import paragraph_dedup as pd

    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(3000)).encode()
    def cut():
        return [(a, b, joined[x:y], h[k]) for joined, found, place, start, end, h in pd.cut(text, 30, 20) for k, x, y, a, b in zip(found, *place, start, end, strict=True)]

    whole = cut()
    monkeypatch.setattr(pd, "SLAB", 97)
    assert cut() == whole
    assert all(text[a:b].split() == words.split() and h == pd.shingle_hashes(words.split())[0] for a, b, words, h in whole)
    # One word again and again is cut every so often, not at every word.
    assert 100 < sum(len(found) for _, found, *_ in pd.cut(b"same " * 5000, 30, 20)) < 400


def test_empty(spark):
    empty = _docs(spark, [])
    assert sh.simhash_dedup(empty).count() == 0
    assert suffix_dedup(empty).count() == 0
    assert paragraph_dedup(empty).count() == 0
