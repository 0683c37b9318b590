"""Types of variables, carried over aliases, copies and arguments of calls.

A variable has the type of its last assignment: of the object that it creates, or of the variable that it takes its value
from. Aliases of a routine so lead back to one root each, found by pointer doubling over the arrays of the
pass over the texts. What then moves are only types of parameters, from call to call: each round joins the parameters that got a type in the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settle
from .tokens import SOURCES, Scan


def last_sources(scan: Scan) -> DataFrame:
    """``path, routine, key, name, type, root``: the last assignment of each variable, with the type it creates, or where the
    chain of variables ends whose value or copy it takes; neither where it is anything else or goes round in a circle."""
    return scan.rows("variable", SOURCES["variable"]).select("path", "routine", F.lower("text").alias("key"), F.col("text").alias("name"), "type", "root")


def propagated_types(scan: Scan, rounds: int = 3) -> DataFrame:
    """``path, routine, name, type, round`` of variables and parameters whose type is known after at most ``rounds`` rounds.

    Round 0 has what a routine itself creates. A parameter gets the type of the first call of its routine in the module, by
    place, that passes a typed name, once; it keeps it. Parameters that are assigned have the type of the assignment.
    """
    variables = last_sources(scan)
    root = variables.where("root is not null").select("path", "routine", "key", "root")
    created = variables.where("type is not null").select("path", "routine", "key", "type")
    parameters = scan.routines.select("path", F.col("name").alias("routine"), F.posexplode("parameters").alias("place", "name")).withColumn("key", F.lower("name"))
    free = settle(parameters.join(variables.select("path", "routine", "key"), ["path", "routine", "key"], "left_anti"))
    calls = scan.rows("call", SOURCES["call"]).where("call.qualifier is null and routine is not null and size(passed) > 0")
    passed = calls.select("path", "at", F.col("routine").alias("caller"), F.lower("call.method").alias("callee"), F.inline("passed"))
    target = free.select("path", "routine", F.lower("routine").alias("callee"), "place", F.col("key").alias("parameter"))
    edges = settle(passed.join(target, ["path", "callee", "place"]).select("path", F.col("caller"), "root", "at", "routine", "parameter"))
    fresh = created.select("path", F.col("routine").alias("caller"), F.col("key").alias("root"), "type")
    told, left = [], free.select("path", "routine", F.col("key").alias("parameter"))
    for n in range(1, rounds + 1):
        new = edges.join(fresh, ["path", "caller", "root"]).join(left, ["path", "routine", "parameter"], "left_semi")
        new = settle(new.groupBy("path", "routine", "parameter").agg(F.min_by("type", "at").alias("type")))
        told.append(new.select("path", "routine", F.col("parameter").alias("key"), "type", F.lit(n).alias("round")))
        if new.isEmpty():
            break
        left = left.join(new.select("path", "routine", "parameter"), ["path", "routine", "parameter"], "left_anti")
        fresh = new.select("path", F.col("routine").alias("caller"), F.col("parameter").alias("root"), "type")
    facts = created.withColumn("round", F.lit(0))
    for t in told:
        facts = facts.unionByName(t)
    facts = settle(facts)
    by_alias = root.join(facts.withColumnRenamed("key", "root"), ["path", "routine", "root"]).select("path", "routine", "key", "type", "round")
    names = variables.select("path", "routine", "key", "name").union(free.select("path", "routine", "key", "name"))
    return facts.unionByName(by_alias).join(names, ["path", "routine", "key"]).select("path", "routine", "name", "type", "round")
