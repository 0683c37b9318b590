"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one is set only where the session names none and runs
    in one process on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by ``cut`` once nothing reads it any more."""
    spark = df.sparkSession
    root = urlparse(shared_dir(spark)).path + "/"
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if urlparse(path).path.startswith(root):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def row_ids(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``row_id``, a hash of id and text. It comes from the row alone, so every scan, retry and re-partitioning
    gives the same value; rows that repeat both share it and share their result."""
    return df.withColumn("row_id", F.xxhash64(F.col(id_column).cast("string"), F.lit("/"), F.col(text)))


def components(edges: DataFrame, max_rounds: int = 40, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large-star and small-star rounds.

    Returns ``(node, component)`` with the smallest node of each component, for nodes with at least one edge to
    another node. Every round is two equi-joins on a node and is cut by a written table; nothing reaches the driver
    but one count and one checksum per round. Null ends and self loops link nothing. An empty table gives no rows.
    """
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs = cut(pairs, "edges")
    state = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        drop_cut(pairs)
        pairs = new
        now = pairs.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def sieve_words(ids: DataFrame) -> int:
    """Words of a bitmap with eight bits or more for each row of ``ids``; 65,536 at least, and 524,288 (4 MB) at most."""
    return min(1 << 19, max(1 << 16, 1 << (ids.count() // 8).bit_length()))


def sieve(df: DataFrame, key: str, ids: DataFrame, rest: bool = False, words: int = 65_536) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the one column of ``ids``: all that are, and some that are not.
    With ``rest`` the other rows, whose key is certainly not there.

    A bitmap of ``words`` words of 64 bits (``sieve_words`` follows the number of ids) is broadcast before a shuffle of
    large rows; a full bitmap lets all rows pass, so a join on the ids must follow.
    """

    def parts(h):  # noqa: ANN001, ANN202
        return F.pmod(h, F.lit(words)).alias("_word"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int").alias("_bit")

    told = ids.select(*parts(F.xxhash64(ids.columns[0]))).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    word, bit = parts(F.xxhash64(key))
    probed = df.withColumn("_word", word).withColumn("_bit", bit)
    hit = F.coalesce(F.expr("(shiftrightunsigned(_bits, _bit) & 1) = 1"), F.lit(False))
    return probed.join(F.broadcast(told), "_word", "left").where(~hit if rest else hit).select(*df.columns)
