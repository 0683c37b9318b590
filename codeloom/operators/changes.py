"""Overlays, snapshots and partial re-indexing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT_FILES = ("configuration.xml", "configdumpinfo.xml")


def overlay(files: DataFrame) -> DataFrame:
    """Of ``(source_index, path, ...)`` one row per path without case: the last source, for root files the first; with
    ``overridden``."""
    key = F.lower("path")
    order = F.when(key.isin(*ROOT_FILES), F.col("source_index")).otherwise(-F.col("source_index"))
    w = Window.partitionBy(key)
    ranked = files.withColumn("_r", F.row_number().over(w.orderBy(order))).withColumn("overridden", F.count("*").over(w) > 1)
    return ranked.where("_r = 1").drop("_r")


def changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """``path, change`` of ``(path, size, mtime)``: added, removed, changed by size or time; paths meet without case."""
    k = known.select(F.lower("path").alias("key"), F.col("path").alias("kp"), F.col("size").alias("ks"), F.col("mtime").alias("km"))
    c = current.select(F.lower("path").alias("key"), F.col("path").alias("cp"), F.col("size").alias("cs"), F.col("mtime").alias("cm"))
    kind = F.when(F.col("kp").isNull(), "added").when(F.col("cp").isNull(), "removed").when((F.col("ks") != F.col("cs")) | (F.col("km") != F.col("cm")), "changed")
    return k.join(c, "key", "full_outer").select(F.coalesce("cp", "kp").alias("path"), kind.alias("change")).where("change is not null")


def gate(changed: DataFrame, known: DataFrame, share: float = 0.2, extension: str = ".bsl") -> DataFrame:
    """One row ``allowed``: whether a partial rebuild will do, with nothing removed, only module files changed, and at
    most ``share`` of all known files."""
    sums = changed.agg(F.count("*").alias("n"), F.count_if(F.col("change") == "removed").alias("gone"), F.count_if(~F.lower("path").endswith(extension)).alias("other"))
    return sums.crossJoin(F.broadcast(known.agg(F.count("*").alias("total")))).select(((F.col("gone") == 0) & (F.col("other") == 0) & (F.col("n") <= share * F.greatest("total", F.lit(1)))).alias("allowed"))


def partial_allowed(changed: DataFrame, known: DataFrame, share: float = 0.2, extension: str = ".bsl") -> bool:
    return gate(changed, known, share, extension).first()["allowed"]


def module_info(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, module_id, owner_id`` of changed module files; null where the index does not know them."""
    modules = nodes.where("kind = 'Module'").select(F.col("source_path").alias("path"), F.col("id").alias("module_id"))
    owners = edges.where("kind = 'Contains'").select(F.col("target_id").alias("module_id"), F.col("source_id").alias("owner_id"))
    return changed.select("path").join(modules, "path", "left").join(owners, "module_id", "left").select("path", "module_id", "owner_id")


def repair_calls(calls: DataFrame, lost: DataFrame) -> DataFrame:
    """Calls ``(target_id, detail, ...)`` after a partial re-index: those of routines that are ``lost(id)`` become calls of
    an external name again, all others stay."""
    gone_ids = lost.select(F.col("id").alias("target_id")).distinct().withColumn("lost", F.lit(True))
    met = calls.join(gone_ids, "target_id", "left")
    return met.withColumn("target_id", F.when(F.col("lost"), F.concat(F.lit("call:"), "detail")).otherwise(F.col("target_id"))).select(*calls.columns)


def replace_rows(old: DataFrame, new: DataFrame, key: str, scope: DataFrame) -> DataFrame:
    """``old`` without the rows whose ``key`` is in ``scope``, with ``new``: a re-index of the changed modules."""
    return old.join(scope.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def gone(old: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return old.select(key).distinct().join(kept.select(key), key, "left_anti")


def first_of(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of frames in order of priority, the first frame that has a key keeps it."""
    whole = reduce(DataFrame.unionByName, [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)])
    order: list[Column] = [F.col("_p"), *[F.col(c) for c in frames[0].columns if c != key]]
    return whole.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r", "_p")
