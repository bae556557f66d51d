"""Exact deduplication, sharding and mixing against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from leafmill.llm.exact_dedup import exact_dedup
from leafmill.llm.mixing import fill_targets, min_cost_flow, mix, route
from leafmill.llm.sharding import best_fit_decreasing, deal_evenly, shard

DOCS = "doc_id long, text string, source string, n_chars long, kept string, size int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "clash", 1) for i, t, s in rows], DOCS)


ROWS = [
    (1, "Same TEXT", "a"), (2, "same text", "a"), (3, None, None), (4, "", "b"), (5, "É", "b"), (6, "é", "b"),
    (7, "long " * 30_000, "c"), (8, "same text", "c"), (9, "x", None), (9, "x", None),
]


def _fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup_matches_brute_force(spark):
    groups = collections.defaultdict(list)
    for i, t, _ in ROWS:
        groups[_fold(t)].append(i)
    want = sorted(
        (i, max(groups[_fold(t)]), len(groups[_fold(t)]), i == max(groups[_fold(t)]), hashlib.sha256(_fold(t).encode()).hexdigest())
        for i, t, _ in ROWS
    )
    got = sorted(map(tuple, exact_dedup(_docs(spark, ROWS)).collect()))
    assert got == want


def test_exact_dedup_heavy_hitters_and_null_ids(spark):
    rows = [(i, "hot", "a") for i in range(300)] + [(1000 + i, f"t{i}", "a") for i in range(200)] + [(None, "z", "a"), (None, "z", "a")]
    got = exact_dedup(_docs(spark, rows), heavy=10).collect()
    assert len(got) == 502
    assert sum(r.kept for r in got if r.doc_id is not None) == 201
    assert {r.keep_id for r in got if r.doc_id is None} == {None}
    assert {r.group_size for r in got if r.keep_id == 299} == {300}


def test_exact_dedup_of_many_frequent_texts(spark):
    """More frequent texts than the sketch has counters: the rest goes by the shuffle, nothing is lost."""
    rows = [(i, f"t{i % 40}", "a") for i in range(1200)]
    want = {(i, 1160 + i % 40, 30, i >= 1160) for i in range(1200)}
    for tracked in (8, 8192):
        got = exact_dedup(_docs(spark, rows), tracked=tracked, heavy=10).collect()
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == 1200


def test_exact_dedup_plan_has_no_python(spark):
    df = exact_dedup(_docs(spark, ROWS))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_empty_tables(spark):
    empty = _docs(spark, [])
    assert exact_dedup(empty).count() == 0
    assert shard(empty).count() == 0
    assert mix(empty.withColumn("sources", F.array("source"))).count() == 0


def _one_by_one(sizes, capacity):
    """Bin of each size, placed one by one in the tightest bin that has room."""
    room, bins = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        bins[i] = b
    return bins


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        assert best_fit_decreasing(sizes, 50) == _one_by_one(sizes, 50)


def test_deal_evenly():
    rng = random.Random(4)
    runs = sorted(collections.Counter(rng.randint(1, 1000) for _ in range(2000)).items(), reverse=True)
    total = collections.Counter()
    for (size, n), pieces in zip(runs, deal_evenly(runs, 16), strict=True):
        assert sum(k for k, _ in pieces) == n
        for k, b in pieces:
            total[b] += size * k
    assert sorted(total) == list(range(16))
    assert max(total.values()) - min(total.values()) < 0.01 * sum(total.values()) / 16
    assert deal_evenly([], 16) == []
    assert deal_evenly([(9, 3), (1, 2)], 5) == [[(1, 4), (1, 3), (1, 2)], [(1, 0), (1, 1)]]
    assert deal_evenly([(9, 1)], 1) == [[(1, 0)]]


@pytest.mark.parametrize("parts", [4096, 8])
def test_every_group_enters_by_decreasing_size(spark, parts):
    """With few parts, sizes and groups are both dealt as seldom ones; the shards must be those of a packing one by one."""
    rng = random.Random(8)
    texts = ["w" * rng.randint(0, 40) + f" {i}" for i in range(300)] + ["long " * 150, "", "same"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    rows += [(i, t, "b") for i, t in enumerate(rng.choices(texts[:20], k=60), 1000)]
    rows += [(2, texts[2], "a"), (2, texts[2], "a"), (None, "no id", "a"), (None, "no id", "a"), (5000, None, None)]
    out = shard(_docs(spark, rows), rows_per_cell=9, parts=parts).collect()
    assert collections.Counter((r.doc_id, r.text_crc32) for r in out) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    size, home = collections.Counter(), collections.defaultdict(set)
    for i, t, _ in rows:
        size[zlib.crc32((t or "").encode())] += len(t or "") + 1
    for r in out:
        home[r.text_crc32].add(r.shard)
    assert all(len(h) == 1 for h in home.values())
    got = collections.Counter((size[g], *h) for g, h in home.items())
    sizes = sorted(size.values(), reverse=True)
    assert got.pop((sizes.pop(0), 15)) == 1  # the long text is above a shard's share
    least = -(-sum(sizes) // 15)
    assert any(collections.Counter(zip(sizes, _one_by_one(sizes, c), strict=True)) == got for c in range(least, least + least // 50))


def test_sharding(spark):
    rng = random.Random(5)
    rows = [(i, "w" * rng.randint(0, 300) + str(i % 150), "a") for i in range(600)] + [(1000, None, None), (1001, "", "a")]
    rows += [(2000 + i, "copy" * 20, "a") for i in range(300)]  # a third of all rows
    out = shard(_docs(spark, rows), rows_per_cell=7).collect()
    text = {i: t for i, t, _ in rows}
    assert len(out) == len(rows)
    size, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in out:
        body = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert set(size) == set(range(16))
    assert max(size.values()) - min(size.values()) <= 0.05 * max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for t, w in where.items() if t != "copy" * 20)


def test_targets_share_all_and_stop_at_the_cap():
    sizes, weights = [10, 1000, 500, 5], [1, 2, 3, 1]
    got = fill_targets(sizes, weights)
    assert got[0] == 30 and got[3] == 15
    assert sum(got) == pytest.approx(sum(sizes))
    assert got[1] / 2 == pytest.approx(got[2] / 3)
    assert fill_targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_min_cost_flow_prefers_cheap_arcs():
    flow = min_cost_flow([(0, 1, 5, 0), (0, 1, 5, 4), (0, 2, 5, 1), (1, 3, 7, 0), (2, 3, 5, 0)], 4, 0, 3)
    assert flow == [5, 2, 5, 7, 5]


def test_overlapping_sources_share_words():
    # Words in both sources go where the other source falls short.
    got = route([((0,), 100), ((0, 1), 100), ((1,), 10)], [150.0, 60.0])
    assert sum(got) == 210 and got[2] <= 30


def _level(sizes, weights, most):
    """Targets by bisection of the common level that weights are multiplied by."""
    low, high = 0.0, float(most * sum(sizes) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * s, mid * w) for s, w in zip(sizes, weights, strict=True)) < sum(sizes) else (low, mid)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_targets_equal_a_common_level():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 8)
        sizes = [rng.choice([0, 1, 50, 1000, 30_000]) for _ in range(n)]
        weights = [(1, 2, 3)[i % 3] for i in range(n)]
        assert fill_targets(sizes, weights) == pytest.approx(_level(sizes, weights, 3.0), rel=1e-6, abs=1e-6)


def _cost(total, size):
    return sum((k // size) ** 2 for k in range(total))


def test_routes_are_cheapest_among_all():
    rng = random.Random(10)
    for _ in range(25):
        a, b, c = (rng.randint(1, 3) for _ in range(3))
        targets = [rng.randint(0, 9), rng.randint(0, 9)]
        best = None
        for x, y, z, w in itertools.product(range(3 * a + 1), range(3 * b + 1), range(3 * b + 1), range(3 * c + 1)):
            if y + z <= 3 * b and x + y <= targets[0] and z + w <= targets[1]:
                found = (-(x + y + z + w), _cost(x, a) + _cost(y + z, b) + _cost(w, c))
                best = found if best is None else min(best, found)
        got = route([((0,), a), ((0, 1), b), ((1,), c)], [float(t) for t in targets])
        assert (-sum(got), sum(_cost(t, n) for t, n in zip(got, (a, b, c), strict=True))) == best


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "b", "c", None])) for i in range(800)]
    rows += [(900, None, "a"), (901, " x", "b")]
    df = _docs(spark, rows).withColumn("sources", F.array("source"))
    out = mix(df).collect()
    again = {r.doc_id: r.taken for r in mix(df.repartition(3)).collect()}
    source, size = {i: s for i, _, s in rows}, {i: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t, _ in rows}
    total = collections.Counter()
    for r in out:
        total[source[r.doc_id]] += size[r.doc_id]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, fill_targets([total[n] for n in names], [(1, 2, 3)[i % 3] for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in out:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and again[r.doc_id] == r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == total[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 30
