"""Where code is entered: event subscriptions, scheduled jobs and form handlers, with the routine that runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("Subscription", "Job", "FormHandler")
FACTS = ["kind", "id", "object_id", "event", "module_path", "procedure"]


def collect(facts: list[DataFrame], symbols: DataFrame, metadata: str | None = None) -> DataFrame:
    """All ``facts`` frames of ``(kind, id, object_id, event, module_path, procedure)`` with the routine they name and
    whether it exists; only those of one object where ``metadata`` is given."""
    whole = facts[0].select(*FACTS)
    for f in facts[1:]:
        whole = whole.unionByName(f.select(*FACTS))
    if metadata:
        whole = whole.where((F.col("object_id") == metadata) | F.col("object_id").startswith(f"{metadata}/"))
    s = symbols.select("module_path", F.col("name").alias("procedure"), F.col("node_id").alias("routine_id"), "start_line").dropDuplicates(["module_path", "procedure"])
    return whole.join(s, ["module_path", "procedure"], "left").select(*FACTS, "routine_id", "start_line", F.col("routine_id").isNotNull().alias("is_resolved"))


def counts(points: DataFrame) -> DataFrame:
    """Points per kind, zeros included."""
    kinds = points.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return kinds.join(points.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def page(points: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` of each kind by id, and whether more exist."""
    w = Window.partitionBy("kind").orderBy("id", "event")
    seen = points.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit + 1)
    more = F.max("r").over(Window.partitionBy("kind")) > limit
    return seen.withColumn("truncated", more).where(F.col("r") <= limit).drop("r")
