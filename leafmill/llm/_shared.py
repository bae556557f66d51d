"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: what ``spark.checkpoint.dir`` names.

    Only where neither the session nor the context has one (local tests), a
    temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
            spark.sparkContext.setCheckpointDir(found)
            spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors: what is reread is
    a table on shared storage, never a block on one machine.
    """
    path = f"{work_dir(df.sparkSession)}/leafmill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that ``settle`` wrote, once nothing that is still to run reads it."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps; Spark deletes them once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, mark, tag: str, most: int = 200_000, words: int = 1 << 18) -> DataFrame:
    """The rows of ``docs`` that ``gone`` (``_id``, ``_mark``) does not name.

    ``mark`` is a column expression over ``docs`` that tells the rows of a
    repeated id apart; it is only computed for rows whose id is named.  Up to
    ``most`` names are broadcast.  Beyond, a Bloom filter of ``words`` 64-bit
    words is broadcast instead, rows that it clears stay where they are, and
    only the others are shuffled to meet the names.
    """
    gone = settle(gone.select("_id", "_mark").distinct(), tag)
    named = lambda d: d.join(
        small if few else gone,
        # Not spelled as an equality, so that marks are compared where ids are equal and not hashed for every row.
        F.col(id_col).eqNullSafe(F.col("_id")) & (mark >= F.col("_mark")) & (mark <= F.col("_mark")),
        "left_anti",
    )
    few = gone.count() <= most
    small = F.broadcast(gone)
    if few:
        return named(docs)
    marked = _bloomed(docs, gone, id_col, "_id", words)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~F.col("_met")).select(*columns).unionByName(named(marked.where("_met").select(*columns)))


def _bloomed(rows: DataFrame, names: DataFrame, id_col: str, name_col: str, words: int) -> DataFrame:
    """Add ``_met``: false only where the id is certainly not among ``names``; a filter of ``words`` 64-bit words is broadcast."""
    bits = (
        names.select(F.pmod(F.xxhash64(name_col), F.lit(words)).alias("_word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({name_col}), 58) as int))").alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )
    h = F.xxhash64(F.col(id_col))
    return rows.join(F.broadcast(bits), F.pmod(h, F.lit(words)) == F.col("_word"), "left").withColumn(
        "_met", F.coalesce(F.getbit("_bits", F.shiftrightunsigned(h, 58).cast("int")) == 1, F.lit(False))
    )


def pick_rows(rows: DataFrame, names: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """The rows whose ``key`` is among ``names``; only rows that pass a Bloom filter of fixed size are shuffled."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return _bloomed(rows, names, key, key, words).where("_met").select(*columns).join(names, key, "left_semi")


def join_hot(rows: DataFrame, names: DataFrame, on: list[str], weight: str, total: int, most: int = 4096) -> DataFrame:
    """Inner join of ``rows`` with ``names``, which has one row per key and in ``weight`` how many of the ``total`` rows have it.

    Keys of ``1/most`` of the rows or more, of which there are at most
    ``most``, are broadcast; only the rows of the others are shuffled.
    """
    often = F.col(weight) * F.lit(most) >= F.lit(total)
    hot = F.broadcast(names.where(often).drop(weight))
    seldom = rows.join(F.broadcast(names.where(often).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(seldom.join(names.where(~often).drop(weight), on))


def fold_case(text):
    """Text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table, by alternating stars.

    ``edges`` has two long columns ``src`` and ``dst``.  Returns
    ``(node, component)`` for every node that has a link to another node;
    ``component`` is the smallest node reachable.  Each round replaces a
    node's links by links to its smallest neighbour (first towards larger
    neighbours, then towards smaller ones), so chains shorten geometrically.
    Minima are aggregated before shuffling and meet their links again in a
    plain equi-join, which adaptive execution can split when a node is hot.
    Every round is written to the shared folder.
    """
    e = settle(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        tag,
    )
    mark = lambda d: d.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), tag)
        now = mark(e)
        if tuple(now) == tuple(seen):
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
