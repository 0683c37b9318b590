"""Practices of a code base: intents recognised in a question, routines scored by evidence, rated modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import call_name
from ..functions.text import same_stem

# What a strong word, a weak word, a named method and a common method add to an intent.
STRONG, WEAK, METHOD, COMMON_METHOD = 4, 2, 5, 2
# Points of a routine per platform method, used kind, name token and comment token.
PER_METHOD, PER_KIND, PER_NAME, PER_COMMENT = 4, 3, 3, 2


def recognise(questions: DataFrame, intents: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """The best intent per question: ``question, intent, score, words``.

    ``questions(question, word)``; ``intents(intent, ord, word, strong)``; ``methods(intent, method, common)``. Words
    meet on their first three signs, then by stem. Ties: score, words, earlier intent.
    """
    q = questions.select("question", F.lower("word").alias("asked"), F.left(F.lower("word"), F.lit(3)).alias("k"))
    i = intents.select("intent", "ord", F.lower("word").alias("known"), "strong", F.left(F.lower("word"), F.lit(3)).alias("k"))
    hit = q.join(F.broadcast(i), "k").where(same_stem("asked", "known"))
    best = hit.groupBy("question", "intent", "ord", "asked").agg(F.max(F.when(F.col("strong"), STRONG).otherwise(WEAK)).alias("points"))
    if methods is not None:
        m = F.broadcast(methods.select("intent", F.lower("method").alias("asked"), F.when(F.col("common"), COMMON_METHOD).otherwise(METHOD).alias("points")))
        named = q.join(m, "asked").join(F.broadcast(intents.select("intent", "ord").distinct()), "intent")
        best = best.union(named.select("question", "intent", "ord", "asked", "points"))
    sums = best.groupBy("question", "intent", "ord").agg(F.sum("points").alias("score"), F.countDistinct("asked").alias("words"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), F.desc("words"), "ord"))
    return sums.withColumn("r", rank).where("r = 1").select("question", "intent", "score", "words")


def score_routines(evidence: DataFrame, methods: list[str], kinds: list[str], tokens: list[str]) -> DataFrame:
    """``id, score`` of routines ``(id, name, comment_head, calls array, kinds array)``; those without points go."""

    def held(values: Column, wanted: list[str]) -> Column:
        return F.size(F.array_intersect(values, F.array(*[F.lit(w) for w in wanted]))) if wanted else F.lit(0)

    has = lambda c: sum((F.coalesce(F.lower(c).contains(t.lower()), F.lit(False)).cast("int") for t in tokens), F.lit(0))
    score = PER_METHOD * held(F.col("calls"), methods) + PER_KIND * held(F.col("kinds"), kinds) + PER_NAME * has("name") + PER_COMMENT * has("comment_head")
    return evidence.select("id", score.alias("score")).where("score > 0")


def platform_matches(edges: DataFrame, method: str, common_modules: DataFrame, limit: int | None = None) -> DataFrame:
    """Routines that call a platform method: by exact target or by last segment of the text, unless the qualifier is a
    common module: ``id, n``."""
    calls = edges.where("kind = 'Calls'").withColumn("qualifier", F.regexp_extract("detail", r"^(.*)\.[^.]*$", 1))
    hit = calls.where((F.lower("target_id") == f"platform:{method.lower()}") | (call_name("detail") == method.lower()))
    free = hit.join(common_modules.select(F.col("name").alias("qualifier")), "qualifier", "left_anti")
    out = free.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "id").limit(limit) if limit else out


def rate_modules(top: DataFrame, symbols: DataFrame) -> DataFrame:
    """``module_path, uses``: the uses of the top routines ``(id, uses)`` summed by their module."""
    return top.join(symbols.select(F.col("node_id").alias("id"), "module_path"), "id").groupBy("module_path").agg(F.sum("uses").alias("uses"))


def routines_by_prefix(symbols: DataFrame, prefixes: list[str]) -> DataFrame:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.lower("name").startswith(p.lower())
    return symbols.where(hit)
