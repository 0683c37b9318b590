"""Cut a plan at a written copy in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. A temporary one is set only where the session names
    none and runs in one process on this machine, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="codeloom-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` read back from Parquet files in the shared folder: later steps neither plan nor compute it again, read only the
    columns they name, and survive the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(df: DataFrame, key: str, ids: DataFrame, name: str, words: int = 1 << 18) -> DataFrame:
    """``df`` with the boolean ``name``: false only where ``key`` is certainly not in the one column of ``ids``.

    A bitmap of ``words`` words of 64 bits is broadcast, whatever the number of ids; a join on them must follow.
    """

    def parts(h: Column) -> list[Column]:
        return [F.pmod(h, F.lit(words)).alias("_word"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int").alias("_bit")]

    told = ids.select(*parts(F.xxhash64(ids.columns[0]))).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    word, bit = parts(F.xxhash64(key))
    probed = df.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(told), "_word", "left")
    return probed.withColumn(name, F.coalesce(F.expr("(shiftrightunsigned(_bits, _bit) & 1) = 1"), F.lit(False))).drop("_word", "_bit", "_bits")
