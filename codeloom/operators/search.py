"""Ranked name search, full-text terms and reference resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens
from ..plans.settle import settle


def ladder(rules: list[tuple[Column, int]]) -> Column:
    """The rank of the first rule that holds; null where none does."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, rank in rules[1:]:
        out = out.when(condition, rank)
    return out


def _lower(*columns: str) -> list[Column]:
    return [F.lower(F.col(c)) for c in columns]


def search_graph(nodes: DataFrame, edges: DataFrame, query: str, synonym: str | None = None, limit: int = 30, offset: int = 0) -> DataFrame:
    """Ten ranks over id, name, synonym, kind and path without case, then degree, then id: ``id, score, degree``.

    Degrees are counted for the hits alone.
    """
    q = query.strip().lower()
    i, n, k, p = _lower("id", "name", "metadata_kind", "source_path")
    s = F.lower(F.col(synonym)) if synonym else F.lit(None).cast("string")
    score = ladder([(i == q, 0), (n == q, 1), (s == q, 2), (i.startswith(q), 3), (n.startswith(q), 4), (i.contains(q), 5), (n.contains(q), 6), (k.contains(q), 7), (s.contains(q), 8), (p.contains(q), 9)])
    hits = nodes.select("id", score.alias("score")).where("score is not null")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    degrees = ends.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    ranked = hits.join(degrees, "id", "left").select("id", "score", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    return ranked.orderBy("score", F.desc("degree"), "id").offset(offset).limit(limit)


def search_index(nodes: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """Exact id, exact name, a token that begins with the query, then any place: by rank, length of name, name, id."""
    q = query.strip().lower()
    found = nodes.where(F.col("kind").isin(*kinds)) if kinds else nodes
    tokens = F.exists(identifier_tokens("name"), lambda t: t.startswith(q))
    rank = ladder([(F.lower("id") == q, 0), (F.lower("name") == q, 1), (F.lower("name").startswith(q), 2), (tokens, 3), (F.lower("name").contains(q) | F.lower("id").contains(q), 4)])
    return found.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length("name"), "name", "id").limit(limit).select("id", "name", "rank")


def staged(hits: DataFrame, stage: str = "stage") -> DataFrame:
    """Only the hits of the first stage that has any: the fallback of a search from exact to loose in one pass. A page is
    not topped up from later stages."""
    return hits.crossJoin(F.broadcast(hits.agg(F.min(stage).alias("_first")))).where(F.col(stage) == F.col("_first")).drop("_first")


def search_objects(objects: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Objects by name or synonym: exact, else prefix, else any place; by stage, length of name, name, id."""
    q = query.strip().lower()
    n, s = F.lower("name"), F.lower("synonym")
    stage = ladder([((n == q) | (s == q), 0), (n.startswith(q) | s.startswith(q), 1), (n.contains(q) | s.contains(q), 2)])
    hits = objects.withColumn("stage", stage).where("stage is not null")
    return staged(hits).orderBy(F.length("name"), "name", "id").limit(limit).select("id", "name", "stage")


def search_nested(items: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """Six ranks over name and synonym of nested items: exact, prefix, any place; name before synonym."""
    q = query.strip().lower()
    n, s = F.lower("name"), F.lower("synonym")
    found = items.where(F.lower("kind").isin(*[k.lower() for k in kinds])) if kinds else items
    rank = ladder([(n == q, 0), (s == q, 1), (n.startswith(q), 2), (s.startswith(q), 3), (n.contains(q), 4), (s.contains(q), 5)])
    return found.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length("name"), "name", "id").limit(limit).select("id", "name", "rank")


def resolve(nodes: DataFrame, edges: DataFrame, reference: str, limit: int = 10) -> DataFrame:
    """The node of that id; where there is none, the search, which else is not planned at all."""
    exact = nodes.where(F.col("id") == reference.strip()).select("id", F.lit(0).alias("stage"))
    return search_graph(nodes, edges, reference, limit=limit).select("id", F.lit(1).alias("stage")) if exact.isEmpty() else exact


def terms(docs: DataFrame, id_column: str, text: str, pattern: str = r"[\p{L}\p{N}]+") -> DataFrame:
    """``(id, term, tf)``: lower-case terms of each text."""
    found = docs.select(F.col(id_column).alias("id"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("term"))
    return found.groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: list[str], id_column: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of texts that hold any of the query's terms.

    Only postings of the query's terms are built; lengths are sizes of arrays, so nothing but the hits is shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    wanted = F.array(*[F.lit(q.lower()) for q in query])
    sized = docs.select(F.col(id_column).alias("id"), words.alias("w")).select("id", F.size("w").alias("dl"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("h"))
    whole = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select("id", "dl", F.explode("h").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # df: a row per query term
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def smart_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols by name: exact, prefix, a token of the name, any place; every stage ranked, the best stage of each."""
    q = query.strip().lower()
    n = F.lower("name")
    stage = ladder([(n == q, 0), (n.startswith(q), 1), (F.array_contains(identifier_tokens("name"), q), 2), (n.contains(q), 3)])
    return symbols.withColumn("stage", stage).where("stage is not null").orderBy("stage", F.length("name"), "name", "node_id").limit(limit).select("node_id", "name", "stage")


def first_stage_search(symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``node_id, name, stage``: symbols of the first stage that has any: the exact name, its prefix, all words of the query
    as prefixes of the terms of name, comment head and parameters (by BM25, then length), any place in the name.

    The stages are asked for in turn, so a later and dearer one is not planned where an earlier one answers.
    """
    from ..sources.inverted import prefix_scores, query_words

    q = query.strip().lower()
    n = F.lower("name")

    def stage(df: DataFrame, number: int) -> DataFrame:
        return df.orderBy(F.length("name"), "name", "node_id").limit(limit).select("node_id", "name", F.lit(number).alias("stage"))

    for number, hit in enumerate((n == q, n.startswith(q))):
        found = stage(symbols.where(hit), number)
        if not found.isEmpty():
            return found
    words = query_words(query)
    if words:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "comment_head", "parameters") if c in symbols.columns]
        # The terms are read once: a row keeps only how many there are and how many begin with each word.
        t = symbols.select("node_id", "name", identifier_tokens(F.concat_ws(" ", *parts)).alias("t"))
        held = settle(t.select("node_id", "name", F.size("t").alias("dl"), *[F.size(F.filter("t", lambda x: x.startswith(w))).alias(f"tf{i}") for i, w in enumerate(words)]))  # noqa: B023
        hits = None
        for i in range(len(words)):
            one = held.select(F.col("node_id").alias("doc_no"), F.lit(i).alias("word"), F.col(f"tf{i}").alias("tf")).where("tf > 0")
            hits = one if hits is None else hits.union(one)
        docs = held.select(F.col("node_id").alias("doc_no"), F.col("node_id").alias("path"), "dl")
        scored = prefix_scores(hits, docs, len(words)).join(held.select(F.col("node_id").alias("path"), "name"), "path")
        found = settle(scored.orderBy(F.desc(F.round("score", 9)), F.length("name"), "name", "path").limit(limit).select(F.col("path").alias("node_id"), "name", F.lit(2).alias("stage")))
        if not found.isEmpty():
            return found
    return stage(symbols.where(n.contains(q)), 3)


def search_topics(topics: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Help topics: exact name or title, last segment, prefix, any place in name, title or text; ranks 0 to 6."""
    q = query.strip().lower().replace("\\", ".").replace("/", ".")
    n, t, x = F.lower("name"), F.lower("title"), F.lower("text")
    rank = ladder([(n == q, 0), (t == q, 1), (F.substring_index(n, ".", -1) == q, 2), (n.startswith(q) | t.startswith(q), 3), (n.contains(q), 4), (t.contains(q), 5), (x.contains(q), 6)])
    return topics.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.length("name"), "name").limit(limit).select("name", "title", "rank")


def topic_aliases(topics: DataFrame) -> DataFrame:
    """``alias, name``: the name, its last segment, and both parts of a title like ``Имя (Name)``, lower-cased."""
    names = F.array(F.col("name"), F.substring_index("name", ".", -1), F.trim(F.regexp_replace("title", r"\s*\(.*$", "")), F.regexp_extract("title", r"\(([^()]+)\)", 1))
    return topics.select("name", F.explode(F.array_distinct(F.transform(names, F.lower))).alias("alias")).where("alias <> ''").select("alias", "name").distinct()


def find_topics(wanted: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic of each ``wanted(alias)``: an equi-join on the aliases, the smallest name where several fit."""
    return wanted.join(topic_aliases(topics), "alias").groupBy("alias").agg(F.min("name").alias("name"))
