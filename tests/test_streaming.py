"""Chunked documents give the same nodes however they are cut."""

import pytest

from leafmill.operators import documents as D
from leafmill.streaming import parse_chunks, parse_stream, split_chunks

PAGES = [(1, "<h1>Größe</h1><p>one <b>two</b><p>três — ü"), (2, ""), (3, "<ul><li>a<li>b</ul>")]


def _rows(df):
    return sorted(map(tuple, df.select("doc_id", "node_id", "kind", "content").collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_any_cut_gives_the_same_nodes(spark, size):
    df = spark.createDataFrame(PAGES, "id long, html string")
    chunks = split_chunks(df, "id", "html", size)
    assert _rows(parse_chunks(chunks.union(chunks).repartition(3), "html")) == _rows(D.nodes(df, "html", "id", "html"))


def test_chunks_are_shuffled_once_and_cut_without_the_rest_of_their_text(spark):
    df = spark.createDataFrame(PAGES, "id long, html string")
    chunks = split_chunks(df, "id", "html", 7)
    generate = [line for line in chunks._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    assert len(generate) == 1 and "html" not in generate[0].split("], false, [")[0].rsplit(", [", 1)[-1]
    plan = parse_chunks(chunks, "html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "InPandas" not in plan
    # Of repeated chunks the greatest counts, wherever it stands.
    twice = spark.createDataFrame([(1, 0, b"<p>b"), (1, 0, b"<p>a"), (1, 1, b"c"), (2, 0, b"<p>x"), (None, 0, b"<p>no")], "doc_id long, seq int, bytes binary")
    assert [r[3] for r in _rows(parse_chunks(twice, "html")) if r[2] == "text"] == ["bc", "x"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "id long, html string")
    chunks = split_chunks(df, "id", "html", 5)
    # Later chunks arrive first.
    chunks.where("seq % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in")
    chunks.where("seq % 2 = 0").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = parse_stream(stream, "html").writeStream.format("memory").queryName("parsed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert _rows(spark.table("parsed")) == _rows(D.nodes(df, "html", "id", "html"))
