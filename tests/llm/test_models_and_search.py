"""Toxicity, packing, nearest neighbours and licence scans."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from leafmill.llm import toxicity as tox
from leafmill.llm.license_scan import TEMPLATES, license_scan
from leafmill.llm.packing import Encoder, pack
from leafmill.llm.permutation_index import footrule, nearest, settings

DOCS = "doc_id long, text string, ids string, p_toxic string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def _corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=40)
        bad, junk = rng.random() < 0.25, rng.random() < 0.3
        if bad:
            w[3] = rng.choice(["scoundrel", "scoundrels", "vermin"])
        if junk:
            w[5] = "clickbait"
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _corpus(600, 1)
    rows += [(1000, None), (1001, ""), (1002, "vermin " + "word " * 20_000)]
    lab = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    docs = _docs(spark, rows)
    got = {r.doc_id: r for r in tox.toxicity(docs, lab).collect()}
    assert len(got) == len(rows)
    held = [(i, t) for i, _, t in labels if i % 2 == 0]
    assert np.mean([got[i].is_toxic == bool(t) for i, t in held]) > 0.95
    assert got[1002].is_toxic and not got[1000].is_toxic and got[1000].p_toxic == got[1001].p_toxic


def test_later_models_see_earlier_log_odds():
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 50, 10)).astype(np.int32) for _ in range(400)]
    first = np.array([1.0 if 7 in d else 0.0 for d in docs])
    chain = tox.fit_chain(docs, np.column_stack([first, first]), ("a", "b"))
    assert chain.models[0].chain.shape == (0,) and chain.models[1].chain.shape == (1,) and chain.models[1].chain[0] > 0


def test_constant_labels_and_empty_input(spark):
    rows, _ = _corpus(20, 3)
    lab = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert not any(r.is_toxic for r in tox.toxicity(_docs(spark, rows), lab).collect())
    assert tox.toxicity(_docs(spark, []), lab).count() == 0


def test_encoder_equals_the_tokenizer():
    e = Encoder()
    texts = ["I'm  can't 'll 12a\t\n\r!!", "Grüße, ÉCOLE ² ½", "ΟΔΟΣ Σας", "日本 語 x", "a b\x85c", "<|endoftext|> hi", "", "é é", "don't'S"]
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e(t), e.wide).tolist() == want.ids


def test_encoder_keeps_what_comes_again(monkeypatch):
    """Ids equal the tokenizer's across generations, and a chunk in every text is tokenized once."""
    from leafmill.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED", 40)
    rng = random.Random(14)
    odd = ["it's", "'ll", "x'", "..'s", "é", "été,", "Ça!", "a1", "12", "²", "don't'S", "ªb", "(a)", "l'été", "İx", "naïve-é"]
    texts = [" ".join(["often", "often,", *("".join(rng.choices("abcdé", k=4)) + rng.choice(["", ",", "'", "1", "½"]) for _ in range(15)), *rng.choices(odd, k=4)]) for _ in range(80)]
    e, met = Encoder(), collections.Counter()

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, piece):
            met[piece] += 1
            return self.model.tokenize(piece)

    e.model = Model(e.model)
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e(t), e.wide).tolist() == want.ids
    assert met["often"] <= 2 and met[","] <= 1 and len(e.chunks) + len(e.older) < 200


def test_packing_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma,", "d'été"], k=rng.randint(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "omega " * 9000), (5, "alpha"), (None, "beta")]
    out = pack(_docs(spark, rows).repartition(5), length=64, keep_ids=True).collect()
    e, by_doc, by_seq = Encoder(), collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    for i, texts in want.items():
        if len(texts) == 1:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == texts[0]
        assert sum(r.length for r in by_doc[i]) == sum(map(len, texts))
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for offset, n in sorted(by_seq[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sizes[:-1] == [64] * (len(sizes) - 1) and 0 < sizes[-1] <= 64
    assert pack(_docs(spark, [])).count() == 0


def test_footrule():
    rng = np.random.default_rng(5)
    rows = np.array([rng.permutation(12)[:5] for _ in range(50)])
    query = rng.permutation(12)[:5]
    place = lambda p: {x: k for k, x in enumerate(p)}
    want = [sum(abs(place(query).get(x, 5) - place(r).get(x, 5)) for x in set(query) | set(r)) for r in rows]
    assert footrule(query, rows, 12).tolist() == want


def _brute(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i in ids:
        if i % 20 == 0:
            s = x @ np.array(vectors[i])
            out[i] = [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != i][:k]
    return out


@pytest.mark.parametrize("n", [15, 1500])
def test_nearest(spark, n):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    good = {i: (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).astype(float).tolist() for i in range(n)}
    good |= {5000 + i: good[0] for i in range(60)}  # copies of one vector
    bad = {9000: None, 9020: [0.0] * 16, 9040: [float("nan")] * 16, 9060: [None] * 16, 9080: [1.0, 2.0]}
    rows = [(i, v, "x") for i, v in (good | bad).items()]
    out = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), block=200).collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    want = _brute(good, 20)
    assert set(out) == set(want)
    hits = []
    for q, found in out.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        for _, v, s in found:
            assert s == pytest.approx(np.dot(good[q], good[v]), rel=1e-12)
        hits.append(len({v for _, v, _ in found} & {v for v, _ in want[q]}) / len(want[q]))
    assert np.mean(hits) >= (1.0 if n < 100 else 0.9)


def test_settings_have_no_step():
    found = [settings(n) for n in range(1, 60_000)]
    for (p, f, c), (p2, f2, c2) in zip(found, found[1:], strict=False):
        assert 0 <= p2 - p <= 1 and 0 <= f2 - f <= 1 and 0 <= c2 - c <= 12
    # Already far below 4,096 vectors the index is one: a query does not score everything.
    assert settings(2000) == (128, 28, 528) and settings(51_282) == (226, 43, 2712)


@pytest.mark.parametrize(("n", "k"), [(25, 20), (128, 20), (100, 60), (600, 20)])
def test_nearest_of_few_unclustered_vectors(spark, n, k):
    rng = np.random.default_rng(n)
    rows = {20 * i: rng.normal(size=24).tolist() for i in range(n)}
    out = collections.defaultdict(list)
    for r in nearest(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), k=k).collect():
        out[r.query_id].append(r.vec_id)
    want = {q: [v for v, _ in found] for q, found in _brute(rows, k).items()}
    assert {q: len(v) for q, v in out.items()} == {q: len(v) for q, v in want.items()}
    hits = [len(set(out[q]) & set(want[q])) / len(want[q]) for q in want]
    assert np.mean(hits) >= (1 if n <= 128 else 0.9)


def test_nearest_of_nothing(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert nearest(spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")).count() == 0


def test_license_scan(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, want = [], set()
    for k, (name, text) in enumerate(sorted(TEMPLATES.items())):
        rows.append((k, f"{noise(rng.randint(0, 50))}\n{text.upper() if k % 2 else text}\n{noise(40)}"))
        want.add((k, name))
    words = TEMPLATES["MIT (grant)"].split()
    rows.append((100, noise(9) + " " + " ".join(words[:-6])))  # most of it
    want.add((100, "MIT (grant)"))
    rows.append((101, " ".join(words[: len(words) // 2])))  # half of it
    rows += [(102, noise(3000)), (103, None), (104, ""), (105, "Licensed under"), (106, noise(20_000) + " " + TEMPLATES["MIT (line)"])]
    want.add((106, "MIT (line)"))
    out = license_scan(_docs(spark, rows)).collect()
    got = {(r.doc_id, r.license) for r in out}
    # The long Apache notice begins with the short line.
    assert got - {(k, "Apache-2.0 (line)") for k in range(20)} == want - {(k, "Apache-2.0 (line)") for k in range(20)}
    assert {x for x in want if x[1] == "Apache-2.0 (line)"} <= got
    assert all(0.8 <= r.containment <= 1 for r in out)
    plan = license_scan(_docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert license_scan(_docs(spark, [])).count() == 0


def _shingles(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_license_scan_against_every_window(spark):
    """Containment of every template in every window, counted one by one and without bands."""
    rng = random.Random(11)
    texts = [TEMPLATES[n].split() for n in sorted(TEMPLATES)]
    rows = [(0, None), (1, ""), (None, " ".join(texts[0]))]
    for i in range(2, 60):
        words = rng.choices(["copy", "work", "the", "of", "license", "zq"], k=rng.randint(0, 120))
        for t in rng.sample(texts, rng.randint(0, 3)):
            part = [w if rng.random() > 0.02 else "zq" for w in t[rng.randint(0, 2) :]]
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((i, " ".join(words)))
    rows += [rows[5], rows[5], (6, rows[9][1])]  # repeated rows, and two texts of one id
    templates = {n: set(_shingles(t)) for n, t in TEMPLATES.items() if _shingles(t)}
    want = {}
    for i, t in rows:
        h = _shingles(t)
        for name, held in templates.items():
            size = max(4, 1 << (len(held) - 1).bit_length())
            for start in range(0, max(1, len(h) - size // 2), size // 2):
                window = h[start : start + size + size // 2]
                share = len(held & set(window)) / len(held)
                if share >= 0.8:
                    found = (share, -start, -(len(window) + 4))
                    want[i, name] = max(want.get((i, name), found), found)
    got = {(r.doc_id, r.license): (r.containment, -r.first_word, -r.n_words) for r in license_scan(_docs(spark, rows)).collect()}
    assert got == {k: (round(v[0], 6), v[1], v[2]) for k, v in want.items()} and len(want) > 40


def test_toxicity_of_repeated_null_and_long_rows(spark):
    rows, labels = _corpus(300, 12)
    odd = [(None, "scoundrel"), (None, None), (7, rows[7][1]), (7, "another text"), (900, "calm " * 60_000), (901, "")]
    lab = spark.createDataFrame([*labels, (3, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    out = tox.toxicity(_docs(spark, rows + odd), lab).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows + odd)
    assert all(0 <= r.p_toxic <= 1 for r in out)
    again = tox.toxicity(_docs(spark, rows + odd).repartition(5), lab).collect()
    key = lambda found: sorted((r.doc_id is None, r.doc_id or 0, r.p_toxic) for r in found)
    assert [k[:2] for k in key(out)] == [k[:2] for k in key(again)]
    assert [k[2] for k in key(out)] == pytest.approx([k[2] for k in key(again)])
