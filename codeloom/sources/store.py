"""The index as Parquet tables: versioned folders with a pointer, snapshots, and exports of the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
POINTER = "_CURRENT"


def write_index(tables: dict[str, DataFrame], root: str) -> str:
    """Write every table into a new version folder, then move the pointer; readers see the old version until then.

    ``edges`` is kept twice, clustered by source and by target, so that either end is skipped by row-group statistics.
    """
    version = uuid.uuid4().hex
    base = f"{root.rstrip('/')}/{version}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if name == "edges":
            for end in ("source_id", "target_id"):
                df.repartitionByRange(end).sortWithinPartitions(end).write.parquet(f"{base}/edges_by_{end}")
        else:
            df.write.parquet(f"{base}/{name}")
    spark.createDataFrame([("schema_version", str(SCHEMA_VERSION))], "key string, value string").coalesce(1).write.parquet(f"{base}/meta")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/{POINTER}")
    return version


def read_index(spark: SparkSession, root: str, table: str, end: str = "source_id") -> DataFrame:
    """A table of the current version; an index of another schema version is refused. Edges come clustered by ``end``:
    ``source_id`` for what a node reaches, ``target_id`` for callers, usages and other questions about incoming edges."""
    version = spark.read.text(f"{root.rstrip('/')}/{POINTER}").first()["value"]
    base = f"{root.rstrip('/')}/{version}"
    found = spark.read.parquet(f"{base}/meta").where("key = 'schema_version'").first()["value"]
    if found != str(SCHEMA_VERSION):
        raise ValueError(f"index has schema version {found}, not {SCHEMA_VERSION}; rebuild it")
    return spark.read.parquet(f"{base}/{f'edges_by_{end}' if table == 'edges' else table}")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node and edge, for ``write.text``: a graph never passes one task as a single document."""
    n = nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.union(edges.select(F.lit("edges"), F.to_json(F.struct(*edges.columns))))


def graph_dot(nodes: DataFrame, edges: DataFrame, root: str | None = None, max_nodes: int = 500, label: int = 48) -> DataFrame:
    """Lines of a DOT graph: the nodes (one step around ``root`` where given, the first ``max_nodes`` by id), then edges
    between them."""
    kept = nodes
    if root:
        near = edges.where(F.col("source_id") == root).select(F.col("target_id").alias("id")).union(edges.where(F.col("target_id") == root).select("source_id")).union(nodes.where(F.col("id") == root).select("id"))
        kept = nodes.join(near.distinct(), "id", "left_semi")
    kept = kept.orderBy("id").limit(max_nodes)
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    short = F.when(F.length("name") > label, F.concat(F.left("name", F.lit(label - 1)), F.lit("…"))).otherwise(F.col("name"))
    n = kept.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(short), F.lit("];")).alias("line"))
    ids = kept.select("id")
    inner = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    e = inner.select("source_id", "target_id", "kind").distinct().select(F.lit(2).alias("ord"), F.concat(F.lit("  "), quote(F.col("source_id")), F.lit(" -> "), quote(F.col("target_id")), F.lit(" [label="), quote(F.col("kind")), F.lit("];")).alias("line"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "ord int, line string")
    return ends.union(n).union(e)


def checker_log(lines: DataFrame) -> DataFrame:
    """Problems of a checker's log ``(path, n, line)``: ``place, at, message, severity, snippet``.

    A line like ``{Module(12,3)}: text`` opens a problem; the lines up to the next one are its snippet, so the opening
    line is carried forward by a window over the lines of a file.
    """
    from pyspark.sql import Window

    opens = F.regexp_extract("line", r"^\{([^}]*)\}:\s*(.*)$", 1)
    w = Window.partitionBy("path").orderBy("n")
    numbered = lines.withColumn("place", F.nullif(opens, F.lit(""))).withColumn("problem", F.sum((opens != "").cast("int")).over(w)).where("problem > 0")
    message = F.regexp_extract("line", r"^\{[^}]*\}:\s*(.*)$", 1)
    grouped = numbered.groupBy("path", "problem").agg(F.max("place").alias("place"), F.max(F.when(F.col("place").isNotNull(), message)).alias("message"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNull() & (F.trim("line") != ""), F.struct("n", "line")))), lambda s: s["line"]), "\n").alias("snippet"))
    at = F.regexp_extract("place", r"\((\d+)", 1)
    severity = F.when(F.lower("message").rlike("предупреждение|warning"), "warning").otherwise("error")
    return grouped.select("path", F.regexp_replace("place", r"\(.*$", "").alias("place"), F.when(at != "", at.cast("int")).alias("at"), "message", severity.alias("severity"), "snippet")
