"""Operators over the property graph: ``nodes(id, kind, name, source_path, metadata_kind, is_external)`` and
``edges(source_id, target_id, kind, line, detail, context)``. All take and return DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import id_kind
from ..plans.settle import marked, settle

KIND_ORDER = ("Configuration", "MetadataObject", "Module", "Routine", "External", "Platform")


def of_kinds(df: DataFrame, kinds: list[str] | None, column: str = "kind") -> DataFrame:
    return df.where(F.col(column).isin(*kinds)) if kinds else df


def node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_.strip())


def counts(df: DataFrame, column: str = "kind") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def dedup_edges(edges: DataFrame) -> DataFrame:
    """No self edges; one edge per (source, target, kind, line, detail, context), nulls equal."""
    return edges.where("source_id <> target_id").dropDuplicates(["source_id", "target_id", "kind", "line", "detail", "context"])


def dedup_nodes(nodes: DataFrame, priority: str = "priority") -> DataFrame:
    """One node per id: the smallest ``priority``, then kind and name. An aggregate, so hot ids combine map-side."""
    rest = [c for c in nodes.columns if c not in ("id", priority)]
    best = nodes.groupBy("id").agg(F.min(F.struct(priority, *rest)).alias("s"))
    return best.select("id", *[F.col(f"s.{c}").alias(c) for c in rest])


def build_options(edges: DataFrame, nodes: DataFrame, containment: bool = True, references: bool = True, calls: bool = True, access: bool = True, external: bool = True) -> DataFrame:
    """The edges that a build with these options would hold."""
    drop = [k for k, keep in (("Contains", containment), ("References", references), ("Calls", calls), ("UsesMetadata", access)) if not keep]
    kept = edges.where(~F.col("kind").isin(*drop)) if drop else edges
    if not external:
        kept = kept.join(nodes.where("is_external").select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*edges.columns)
    return kept


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many edges end at an external node."""
    return edges.join(nodes.where("is_external").select(F.col("id").alias("target_id")), "target_id").agg(F.count("*").alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, incoming, outgoing`` of every node: one aggregate over both ends, then one join."""
    ends = edges.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("source_id", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    return nodes.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("incoming", "outgoing")])


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts by kind of node and edge."""
    n = nodes.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in KIND_ORDER], F.count_if("is_external").alias("external"))
    e = edges.agg(F.count("*").alias("edges"), *[F.count_if(F.col("kind") == k).alias(f"e_{k.lower()}") for k in ("Contains", "References", "Defines", "Calls", "UsesMetadata")])
    return n.crossJoin(F.broadcast(e))  # one row each


def outgoing(edges: DataFrame, id_: str, kind: str | None = None, limit: int | None = None, end: str = "source_id") -> DataFrame:
    found = of_kinds(edges.where(F.col(end) == id_), [kind] if kind else None)
    found = found.orderBy("kind", F.col("line").asc_nulls_first(), "source_id", "target_id", F.col("detail").asc_nulls_first())
    return found.limit(limit) if limit else found


def incoming(edges: DataFrame, id_: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    return outgoing(edges, id_, kind, limit, "target_id")


def _ends(edges: DataFrame, id_: str, end: str, other: str, limit: int | None) -> DataFrame:
    found = edges.where((F.col("kind") == "Calls") & (F.col(end) == id_)).select(other).distinct()
    return found.orderBy(other).limit(limit) if limit else found


def callers(edges: DataFrame, id_: str, limit: int | None = None) -> DataFrame:
    """Different callers; in order of id, at most ``limit``, where one is given."""
    return _ends(edges, id_, "target_id", "source_id", limit)


def callees(edges: DataFrame, id_: str, limit: int | None = None) -> DataFrame:
    return _ends(edges, id_, "source_id", "target_id", limit)


def callers_by_text(edges: DataFrame, callee: str) -> DataFrame:
    return edges.where((F.col("kind") == "Calls") & (F.col("detail") == callee)).select("source_id", "target_id", "line", "detail")


def usages(refs: DataFrame, nodes: DataFrame, target: str | None = None, context: str | None = None) -> DataFrame:
    """References with name and file of the reader; of one target and context where given."""
    found = refs.where(F.col("target_id") == target) if target else refs
    found = found.where(F.col("context") == context) if context else found
    reader = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("reader_name"), F.col("source_path").alias("reader_path"))
    return found.join(reader, "source_id", "left").select("source_id", "target_id", "context", "line", "detail", "reader_name", "reader_path")


def usage_by_context(refs: DataFrame) -> DataFrame:
    return refs.groupBy("target_id", "context").agg(F.count("*").alias("n"))


def usage_summary(refs: DataFrame, readers: int = 10) -> DataFrame:
    """Of every target: all uses, uses by derived kind, different readers, and the top readers with their first use.

    Ties: more uses first, then the reader's id; the first use has the smallest line (null last), context, detail.
    """
    first = F.min(F.struct(F.coalesce("line", F.lit(2**31 - 1)).alias("l"), F.col("context").alias("c"), F.coalesce("detail", F.lit("")).alias("d")))
    uses = F.count_if(F.col("context").isin("code", "query"))
    per = refs.groupBy("target_id", "source_id").agg(F.count("*").alias("n"), uses.alias("u"), first.alias("f"))
    # Totals are sums over the readers, which are far fewer than the references.
    kinds = per.groupBy("target_id").agg(F.sum("n").alias("total"), F.sum("u").alias("uses_metadata"), (F.sum("n") - F.sum("u")).alias("refers"), F.count("*").alias("readers"))
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("n"), "source_id"))
    top = per.withColumn("rank", rank).where(F.col("rank") <= readers)
    return top.join(kinds, "target_id").select("target_id", "total", "uses_metadata", "refers", "readers", "rank", "source_id", "n", F.nullif(F.col("f.l"), F.lit(2**31 - 1)).alias("first_line"), F.col("f.c").alias("first_context"))


def rank_routines(edges: DataFrame, limit: int, prefix: str = "") -> DataFrame:
    """Most called targets: ``id, uses, callers``, uses first, then id."""
    calls = edges.where((F.col("kind") == "Calls") & F.col("target_id").startswith(prefix))
    return calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("uses"), F.countDistinct("source_id").alias("callers")).orderBy(F.desc("uses"), "id").limit(limit)


def kinds_of_targets(edges: DataFrame) -> DataFrame:
    """Per source: the different kinds it uses, joined, and how many uses it has."""
    used = edges.where("kind = 'UsesMetadata'")
    return used.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("context")), ",").alias("contexts"), F.count("*").alias("n"))


def called_kinds(edges: DataFrame) -> DataFrame:
    """Per routine: kinds of all metadata it uses, repeats kept, in order."""
    used = edges.where("kind = 'UsesMetadata'").select("source_id", id_kind(F.replace("target_id", F.lit(":"), F.lit("."))).alias("k"))
    return used.groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("kinds"))


def calls_of_method(edges: DataFrame, method: str) -> DataFrame:
    """Per routine: calls whose last segment is ``method``, without case."""
    hit = edges.where((F.col("kind") == "Calls") & (F.lower(F.substring_index("detail", ".", -1)) == method.lower()))
    return hit.groupBy("source_id").agg(F.count("*").alias("n"))


def first_calls(edges: DataFrame) -> DataFrame:
    """An example per call target: the first by line, source and detail."""
    first = edges.where("kind = 'Calls'").groupBy("target_id").agg(F.min(F.struct(F.col("line"), F.col("source_id"), F.col("detail"))).alias("f"))
    return first.select("target_id", "f.source_id", "f.line", "f.detail")


def caller_sites(edges: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every call with the caller's name and module, from its symbol or else from its node."""
    calls = edges.where("kind = 'Calls'").select("source_id", "target_id", "line")
    named = calls.join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("node_name"), F.col("source_path")), "source_id")
    seen = named.join(symbols.select(F.col("node_id").alias("source_id"), F.col("name").alias("symbol_name"), "module_path"), "source_id", "left")
    return seen.select("source_id", "target_id", "line", F.coalesce("symbol_name", "node_name").alias("caller"), F.coalesce("module_path", "source_path").alias("path"))


def decorate(ids: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Evidence of routines ``ids(id)``: symbol, uses, different callers, first call and used contexts."""
    calls = edges.where("kind = 'Calls'")
    uses = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("uses"), F.countDistinct("target_id").alias("targets"), F.min(F.struct("line", "detail")).alias("first"))
    kinds = kinds_of_targets(edges).select(F.col("source_id").alias("id"), "contexts")
    named = symbols.select(F.col("node_id").alias("id"), "module_path", "start_line")
    out = ids.join(named, "id", "left").join(uses, "id", "left").join(kinds, "id", "left")
    return out.select("id", "module_path", "start_line", F.coalesce("uses", F.lit(0)).cast("long").alias("uses"), F.coalesce("targets", F.lit(0)).cast("long").alias("targets"), F.col("first.detail").alias("first_call"), F.coalesce("contexts", F.lit("")).alias("contexts"))


def module_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``owner_id, path``: modules that an owner contains."""
    modules = nodes.where("kind = 'Module'").select(F.col("id").alias("target_id"), F.col("source_path").alias("path"))
    return edges.where("kind = 'Contains'").join(modules, "target_id").select(F.col("source_id").alias("owner_id"), "path").distinct()


def file_owners(edges: DataFrame, nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """``path, owner_id``: the object that a file describes, else the owner of its module."""
    by_module = module_paths(edges, nodes).groupBy("path").agg(F.min("owner_id").alias("m"))
    by_object = objects.where("source_path is not null").groupBy(F.col("source_path").alias("path")).agg(F.min("id").alias("o"))
    return by_module.join(by_object, "path", "full_outer").select("path", F.coalesce("o", "m").alias("owner_id"))


def _both(edges: DataFrame, direction: str) -> DataFrame:
    ways = {"out": [("source_id", "target_id")], "in": [("target_id", "source_id")], "both": [("source_id", "target_id"), ("target_id", "source_id")]}[direction]
    return reduce(DataFrame.union, [edges.select(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in ways])


def reach(edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """``id, depth``: nodes within ``depth`` steps of ``starts(id)`` and the fewest steps.

    Breadth first, a join of the frontier per step (an OR over both directions would not hash); ids already met go by
    an anti-join, so walks are never enumerated and hubs cost their degree once.
    """
    steps = _both(of_kinds(edges, kinds), direction).distinct()
    frontier = starts.select("id").distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        near = steps.join(frontier.withColumnRenamed("id", "x"), "x").select(F.col("y").alias("id")).distinct()
        frontier = near.join(seen, "id", "left_anti")
        if d < depth and edges.sparkSession.conf.get("spark.checkpoint.dir", None):
            frontier = frontier.checkpoint()
        seen = seen.union(frontier.withColumn("depth", F.lit(d)))
    return seen


def neighborhood(edges: DataFrame, starts: DataFrame, depth: int = 1, direction: str = "both", kinds: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """Edges with both ends among the nodes reached (the first ``max_nodes`` by depth and id)."""
    met = reach(edges, starts, depth, direction, kinds)
    if max_nodes:
        met = met.orderBy("depth", "id").limit(max_nodes)
    ids = met.select("id")
    kept = of_kinds(edges, kinds).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "kind", "line", "detail")


def cards(nodes: DataFrame, edges: DataFrame, per_side: int = 40) -> DataFrame:
    """Per node: degrees and the first ``per_side`` edges of each side as text, by kind, line and other end.

    Edges are made once, and only those are sorted that may end at one of the nodes.
    """
    ids = nodes.select("id")
    near = marked(marked(edges.select("source_id", "target_id", "kind", "line", "detail"), "source_id", ids, "_source_id"), "target_id", ids, "_target_id")
    near = settle(near.where("_source_id or _target_id"))

    def side(end: str, other: str, name: str) -> DataFrame:
        own = near.where(f"_{end}").withColumnRenamed(end, "id")
        order = Window.partitionBy("id").orderBy("kind", F.col("line").asc_nulls_first(), other, F.col("detail").asc_nulls_first())
        # The rank alone, so that each task keeps the first few edges of a hub before the shuffle; counts combine too.
        ranked = own.select("id", other, "kind", "line", "detail", F.row_number().over(order).alias("r")).where(F.col("r") <= per_side)
        packed = F.sort_array(F.collect_list(F.struct("r", "kind", other)))
        first = ranked.groupBy("id").agg(F.array_join(F.transform(packed, lambda x: F.concat_ws(" ", x["kind"], x[other])), ";").alias(name))
        return own.groupBy("id").agg(F.count("*").alias(f"n_{name}")).join(first, "id")

    out = nodes.select("id", "kind", "name").join(side("source_id", "target_id", "outgoing"), "id", "left").join(side("target_id", "source_id", "incoming"), "id", "left")
    return out.select("id", "kind", "name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_outgoing", "n_incoming")], *[F.coalesce(c, F.lit("")).alias(c) for c in ("outgoing", "incoming")])


def children_page(objects: DataFrame, parent: str, limit: int, offset: int = 0, sections: list[str] | None = None) -> DataFrame:
    """A page of children by kind and name, each with the total."""
    found = objects.where(F.col("parent_id") == parent)
    found = found.where(F.lower("kind").isin(*[s.lower() for s in sections])) if sections else found
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("kind", "name", "id").offset(offset).limit(limit).crossJoin(F.broadcast(total)).select("id", "kind", "name", "total")


def bounded_page(rows: DataFrame, partition: list[str], order: list[Column | str], size: Column, budget: int) -> DataFrame:
    """Rows of each partition while the running sum of ``size`` stays in ``budget`` (the first always)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("used", F.sum(size).over(w)).withColumn("nth", F.count("*").over(w))
    return seen.where((F.col("used") <= budget) | (F.col("nth") == 1)).drop("nth")


def tree_counts(objects: DataFrame, depth: int = 4) -> DataFrame:
    """Items per kind over the whole tree below each root ``(id, kind, parent_id)``: one join per level."""
    level = objects.where("parent_id is null").select(F.col("id").alias("root"), F.col("id").alias("at"))
    found = None
    for _ in range(depth):
        level = level.join(objects.select(F.col("parent_id").alias("at"), F.col("id").alias("child"), "kind"), "at").select("root", F.col("child").alias("at"), "kind")
        found = level if found is None else found.union(level)
        level = level.select("root", "at")
    return found.groupBy("root", "kind").agg(F.count("*").alias("n"))


def tree_cards(objects: DataFrame) -> DataFrame:
    """Objects with their children and grandchildren nested bottom-up: ``id, children array<struct<id, kind, items>>``."""
    kids = objects.where("parent_id is not null")
    leaf = kids.groupBy("parent_id").agg(F.array_sort(F.collect_list("id")).alias("items")).withColumnRenamed("parent_id", "id")
    mid = kids.join(leaf, "id", "left").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("kind", "id", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))).alias("children"))
    return objects.where("parent_id is null").select("id").join(mid.withColumnRenamed("parent_id", "id"), "id", "left")


def call_ranks(edges: DataFrame, nodes: DataFrame, kind: str = "Platform", most: int = 3, edge_kind: str = "Calls") -> DataFrame:
    """``source_id, target_id, n, rank``: what of the platform each routine uses most, ties by target."""
    targets = nodes.where(F.col("kind") == kind).select(F.col("id").alias("target_id"))
    used = edges.where(F.col("kind") == edge_kind).join(targets, "target_id", "left_semi").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("n"), "target_id"))
    return used.withColumn("rank", rank).where(F.col("rank") <= most)


def ranked_with_owner(edges: DataFrame, symbols: DataFrame, limit: int, prefix: str = "") -> DataFrame:
    """The most called routines with symbol, module and owner of the module: three left joins after the top ones."""
    top = rank_routines(edges, limit, prefix)
    named = symbols.select(F.col("node_id").alias("id"), "name", "module_path")
    owners = edges.where("kind = 'Contains'").select(F.col("target_id").alias("module_path"), F.col("source_id").alias("owner_id"))
    return top.join(named, "id", "left").join(owners, "module_path", "left").select("id", "uses", "callers", "name", "module_path", "owner_id")


def type_info(objects: DataFrame, refs: DataFrame, most: int = 8) -> DataFrame:
    """``id, types``: different targets of the own type references, then of those of the owner whose detail holds the
    name of the child; at most ``most``, own first, then by target.

    A name is held by a detail where it equals one of its pieces of the same length, so children and details meet on owner
    and piece; the pieces have the lengths that names below the owner have. No owner's children meet all its references.
    """
    typed = refs.where("context = 'type'")
    own = objects.select("id").join(typed.select(F.col("source_id").alias("id"), "target_id"), "id").select("id", "target_id", F.lit(0).alias("stage"))
    child = objects.where("parent_id is not null").select("id", "name", "parent_id")
    lengths = child.groupBy("parent_id").agg(F.collect_set(F.length("name")).alias("lengths"))
    details = typed.where("detail is not null").select(F.col("source_id").alias("parent_id"), "target_id", "detail").distinct().join(lengths, "parent_id")
    size = F.length("detail")
    fits = F.filter("lengths", lambda n: n <= size)
    pieces = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("detail"), i, n))))
    held = details.select("parent_id", "target_id", F.explode(F.array_distinct(pieces)).alias("name")).distinct()
    of_owner = child.join(held, ["parent_id", "name"]).select("id", "target_id", F.lit(1))
    first = own.union(of_owner).groupBy("id", "target_id").agg(F.min("stage").alias("stage"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("stage", "target_id"))
    kept = first.withColumn("r", rank).where(F.col("r") <= most)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "target_id"))), lambda s: s["target_id"]), ",").alias("types"))
