"""A store of module tables that is renewed in part: buckets of modules, a manifest of their versions, a pointer to it.

Rows of a module lie in one bucket by a hash of its path. A renewal writes new versions of the buckets that change and a new
manifest; the pointer moves last, so readers see the old state or the new one. What a bucket holds is read by its folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import build, code
from ..plans.settle import settle
from ..plans.tokens import TYPED, Scan

POINTER = "_CURRENT"
TABLES = ("routines", "types", "calls")
CALL = ["path", "routine", "line", "callee", "qualifier", "method"]


class PartialStore:
    """Tables with a ``path`` below ``root``, in ``buckets`` buckets. The manifest has a row for each table and bucket, so its
    size is set by ``buckets`` alone and it may pass through the driver."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))

    def manifest(self) -> dict[tuple[str, int], str]:
        current = self.spark.read.text(f"{self.root}/{POINTER}").first()["value"]
        return {(r["table"], r["bucket"]): r["version"] for r in self.spark.read.parquet(f"{self.root}/manifest/{current}").collect()}

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of all or some buckets; only their folders are read."""
        by_version: dict[str, list[int]] = {}
        for (name, k), version in self.manifest().items():
            if name == table and (buckets is None or k in buckets):
                by_version.setdefault(version, []).append(k)
        out = None
        for version, own in sorted(by_version.items()):
            df = self.spark.read.parquet(f"{self.root}/{table}/{version}").where(F.col("bucket").isin(own)).drop("bucket")
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.read.parquet(f"{self.root}/{table}/{next(iter(self.manifest().values()))}").drop("bucket").limit(0)
        return out

    def write(self, tables: dict[str, DataFrame], buckets: list[int] | None = None) -> int:
        """Write the rows of some buckets (all of them unless given) as a new version and move the pointer; how many buckets
        of tables were written."""
        version = uuid.uuid4().hex
        some = list(range(self.buckets)) if buckets is None else sorted(buckets)
        known = {} if buckets is None else self.manifest()
        for name, df in tables.items():
            self.bucket(df).repartition("bucket").sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
            known |= {(name, k): version for k in some}
        rows = [(name, k, v) for (name, k), v in known.items()]
        self.spark.createDataFrame(rows, "table string, bucket int, version string").coalesce(1).write.parquet(f"{self.root}/manifest/{version}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{POINTER}")
        return len(tables) * len(some)


def module_tables(texts: DataFrame, help_names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Routines, types of variables and resolved calls of modules ``(path, text)``."""
    scan = Scan(texts, "header", "call", **TYPED)
    routines, types = scan.routines, code.last_types(texts, scan.routines, scan)
    calls = code.calls(texts, routines, scan, nested=False)
    return {"routines": routines, "types": types, "calls": resolved(calls, routines, help_names, types)}


def resolved(calls: DataFrame, routines: DataFrame, help_names: DataFrame | None, types: DataFrame) -> DataFrame:
    out = build.resolve(calls, routines, help_names, types)
    # The parts of a callee are kept, as a later renewal resolves the call again.
    qualifier = F.when(F.contains("callee", F.lit(".")), F.regexp_replace("callee", r"\.[^.]*$", ""))
    return out.withColumn("qualifier", qualifier).withColumn("method", F.substring_index("callee", ".", -1)).select(*CALL, "target_id", "stage")


def renew(store: PartialStore, changed: DataFrame, removed: DataFrame | None = None, help_names: DataFrame | None = None) -> int:
    """Bring the store up to date with the modules ``changed(path, text)`` and without those of ``removed(path)``; how many
    buckets of tables were written.

    Calls of other modules are resolved again where their method is the name of a routine that came or went: calls whose
    target is lost, and calls that now find one. Every other call keeps its target, as its stages ask for names that did
    not change. The state equals that of a full build.
    """
    gone = changed.select("path") if removed is None else changed.select("path").union(removed.select("path"))
    gone = settle(gone.distinct())
    scan = Scan(changed, "header", "call", **TYPED)
    new_types = settle(code.last_types(changed, scan.routines, scan))
    old = store.read("routines")
    before, now = old.join(gone, "path", "left_semi").select("path", "name"), scan.routines.select("path", "name")
    touched = before.exceptAll(now).union(now.exceptAll(before)).select(F.col("name").alias("method")).distinct()
    calls = store.read("calls")
    kept = calls.join(gone, "path", "left_anti")
    again = settle(kept.join(touched, "method", "left_semi").select(*CALL))
    routines = old.join(gone, "path", "left_anti").unionByName(scan.routines)
    types = store.read("types").join(gone, "path", "left_anti").unionByName(new_types)
    fresh = settle(resolved(again.unionByName(code.calls(changed, scan.routines, scan, nested=False)), routines, help_names, types))
    of_modules = {r["bucket"] for r in store.bucket(gone).select("bucket").distinct().collect()}
    of_calls = of_modules | {r["bucket"] for r in store.bucket(again.select("path").distinct()).select("bucket").distinct().collect()}
    some = sorted(of_calls)
    same = store.read("calls", some).join(gone, "path", "left_anti").join(touched, "method", "left_anti")
    tables = {"calls": same.unionByName(fresh)}
    for name, new in (("routines", scan.routines), ("types", new_types)):
        tables[name] = store.read(name, some).join(gone, "path", "left_anti").unionByName(new)
    tables = {name: settle(df) for name, df in tables.items()}
    return store.write(tables, some)
