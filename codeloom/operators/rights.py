"""Access rights of roles on objects, with row-level conditions: ``rights(role_id, object_id, read, insert, has_rls, condition)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_key(rights: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Granted, denied and restricted counts per role or per object."""
    granted = sum((F.sum(F.col(f).cast("int")) for f in flags), F.lit(0))
    denied = sum((F.sum((~F.col(f)).cast("int")) for f in flags), F.lit(0))
    return rights.groupBy(key).agg(F.count("*").alias("n"), granted.cast("long").alias("granted"), denied.cast("long").alias("denied"), F.count_if("has_rls").alias("restricted"))


def condition_search(rights: DataFrame, text: str) -> DataFrame:
    """Rights whose condition holds the text, without case."""
    return rights.where(F.lower("condition").contains(text.lower()))


def condition_totals(rights: DataFrame, text: str) -> DataFrame:
    return condition_search(rights, text).agg(F.count("*").alias("matches"), F.countDistinct("role_id").alias("roles"), F.countDistinct("object_id").alias("objects"))


def on_object(rights: DataFrame, object_id: str) -> DataFrame:
    return rights.where(F.col("object_id") == object_id).drop("condition")


def of_role(rights: DataFrame, role: str) -> DataFrame:
    """Rights of a role by id or bare name, without case."""
    return rights.where(F.lower("role_id").isin(role.lower(), f"role.{role.lower()}")).drop("condition")
