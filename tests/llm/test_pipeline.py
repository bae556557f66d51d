"""The corpus pipeline on a small folder: each stage against its operator."""

import corpus_pipeline
from leafmill.llm.packing import pack
from leafmill.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _folder(spark, path):
    good = "plain words that say nothing of note about item number {} and stop here at last"
    rows = [(i, good.format(f"{i * 7919} {i * 104729}"), "en", f"src{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, "you vermin " + good.format(i * 31), "en", "src0", 1) for i in range(15)]
    rows += [(200 + i, "The Same Text Once Again", "en", "src1", 1) for i in range(5)] + [(300, None, None, None, None), (301, "", "en", None, 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(100 + i, 1, 1) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = _folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    clean = [r[0] for r in rows if not 100 <= r[0] < 200]
    assert ids[0] == sorted(clean)
    assert ids[1] == sorted(set(clean) - {200, 201, 202, 203, 300})
    # Only the two empty texts could still be near each other, and one is left by now.
    assert set(ids[2]) <= set(ids[1]) and len(ids[2]) >= len(ids[1]) - 2
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in ids[3]) <= 3
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:4])
    key = ["doc_id", "doc_tokens", "length"]
    total = lambda d: sum(r.length for r in d.select(*key).collect())
    assert total(seen[4]) == total(pack(seen[3]))


def test_null_and_repeated_ids_are_judged_by_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"term{i}" for i in range(60))
    docs = lambda rows: spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], COLUMNS)
    kept = lambda d: sorted(((r.doc_id or 0, r.text) for r in d.collect()))
    exact = corpus_pipeline._exact(spark, docs([(1, text, "a"), (1, other, "a"), (2, text, "a"), (None, text, "a"), (None, "alone", "a")]), "")
    assert kept(exact) == [(0, "alone"), (1, other), (2, text)]
    near = corpus_pipeline._near(spark, docs([(1, text, "a"), (2, text + " more", "a"), (2, other, "a"), (None, text, "a")]), "")
    assert kept(near) == [(0, text), (1, text), (2, other)]
    # Equal weights of one source: the mix takes each document at least once.
    mixed = corpus_pipeline._mixing(spark, docs([(i, text, "a") for i in range(1, 9)] + [(None, other, "a")]), "")
    assert {r.text for r in mixed.where("doc_id is null").collect()} == {other}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_dropping_rows_by_a_bloom_filter_equals_broadcasting(spark):
    from pyspark.sql import functions as F

    from leafmill.llm._shared import drop_rows

    rows = [(i if i % 17 else None, f"text {i}", "en", "a", 1) for i in range(400)] + [(5, "other", "en", "a", 1), (5, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    gone = docs.where("n_chars = 1 and (doc_id % 3 = 0 or doc_id is null or text = 'text 5')").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"))
    got = [sorted((r.doc_id or -1, r.text or "") for r in drop_rows(docs, gone, "doc_id", F.xxhash64("text"), "t", most, 8).collect()) for most in (1000, 0)]
    want = sorted((i or -1, t or "") for i, t, *_ in rows if not (i is None or i % 3 == 0 or t == "text 5"))
    assert got[0] == got[1] == want
