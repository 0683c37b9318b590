"""What help pages say about functions: parameter bounds, names known to the platform, members of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import _c


def parameter_bounds(text: str | Column) -> Column:
    """``struct<required int, total int>`` from the parameter section of a page, where each parameter stands in angle
    brackets with (обязательный) or (необязательный) behind it; null where there are several variants of the syntax or
    neither a parameter section nor a syntax without parameters."""
    t = _c(text)
    part = F.regexp_extract(t, r"(?s)Параметры:(.*)$", 1)
    count = lambda word: F.regexp_count(part, F.lit(rf"(?iu)<[^<>]+>\s*\({word}\)"))
    required, optional = count("обязательный"), count("необязательный")
    told = F.struct(required.cast("int").alias("required"), (required + optional).cast("int").alias("total"))
    empty = F.struct(F.lit(0).alias("required"), F.lit(0).alias("total"))
    bare = t.rlike(r"(?iu)Синтаксис:\s*[\p{L}\p{N}_.]+\(\s*\)")
    return F.when(t.rlike("(?iu)Вариант синтаксиса"), None).when(F.contains(t, F.lit("Параметры:")), told).when(bare, empty)


def builtin_names(topics: DataFrame, context: str) -> DataFrame:
    """``kind, name`` of topics ``(name)`` like ``Context.Name``: members of the global context are functions, the first
    segments of the others are types; lower-cased, once each."""
    first, rest = F.substring_index("name", ".", 1), F.regexp_replace("name", r"^[^.]*\.", "")
    is_global = F.lower(first) == context.lower()
    kind = F.when(is_global, "function").otherwise("type")
    return topics.where(F.contains("name", F.lit("."))).select(kind.alias("kind"), F.lower(F.when(is_global, rest).otherwise(first)).alias("name")).distinct()


def members(asked: DataFrame, topics: DataFrame) -> DataFrame:
    """``type, member, found`` of ``asked(type, member)``: whether a topic ``Type.Member`` exists, without case."""
    known = topics.select(F.lower("name").alias("key")).distinct().withColumn("hit", F.lit(True))
    keyed = asked.withColumn("key", F.lower(F.concat_ws(".", "type", "member")))
    return keyed.join(known, "key", "left").select("type", "member", F.coalesce("hit", F.lit(False)).alias("found"))
