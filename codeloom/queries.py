"""One query per operator over the test tables, and the same question as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import names, text
from .operators import changes, check, conventions, entrypoints, graph, grep, rights, search, similar
from .plans.driver import Tables, sql
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Aggregations


@query("a01_nodes_by_kind", sql("SELECT kind, count(*) AS n FROM nodes GROUP BY kind", "nodes"))
def _(t: Tables) -> DataFrame:
    return graph.counts(t.nodes)


@query("a01_edges_by_kind", sql("SELECT kind, count(*) AS n FROM edges GROUP BY kind", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.counts(t.edges)


@query("a02_refs_by_context", sql("SELECT context, count(*) AS n FROM refs GROUP BY context", "refs"))
def _(t: Tables) -> DataFrame:
    return graph.counts(t.refs, "context")


@query("a03_degrees", sql("SELECT id, (SELECT count(*) FROM edges WHERE target_id = id) AS incoming, (SELECT count(*) FROM edges WHERE source_id = id) AS outgoing FROM nodes", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.degrees(t.nodes, t.edges)


@query("a04_index_statistics", sql("""SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM symbols) AS symbols,
    (SELECT count(*) FROM objects) AS objects, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM symbols WHERE is_export) AS exported""", "nodes", "edges", "symbols", "objects", "refs"))
def _(t: Tables) -> DataFrame:
    parts = [("nodes", t.nodes), ("edges", t.edges), ("symbols", t.symbols.drop("comment_head")), ("objects", t.objects), ("refs", t.refs), ("exported", t.symbols.where("is_export"))]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


@query("a05_graph_statistics", sql("""SELECT * FROM (SELECT count(*) AS nodes, count(*) FILTER (kind = 'Configuration') AS n_configuration, count(*) FILTER (kind = 'MetadataObject') AS n_metadataobject,
    count(*) FILTER (kind = 'Module') AS n_module, count(*) FILTER (kind = 'Routine') AS n_routine, count(*) FILTER (kind = 'External') AS n_external, count(*) FILTER (kind = 'Platform') AS n_platform,
    count(*) FILTER (is_external) AS external FROM nodes), (SELECT count(*) AS edges, count(*) FILTER (kind = 'Contains') AS e_contains, count(*) FILTER (kind = 'References') AS e_references,
    count(*) FILTER (kind = 'Defines') AS e_defines, count(*) FILTER (kind = 'Calls') AS e_calls, count(*) FILTER (kind = 'UsesMetadata') AS e_usesmetadata FROM edges)""", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.graph_statistics(t.nodes, t.edges)


@query("a06_usage_by_context", sql("SELECT target_id, context, count(*) AS n FROM refs GROUP BY ALL", "refs"))
def _(t: Tables) -> DataFrame:
    return graph.usage_by_context(t.refs)


@query("a06_usage_summary", sql("""SELECT p.target_id, total, uses_metadata, refers, readers, rank, p.source_id, n, nullif(first_line, 2147483647) AS first_line, first_context
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY n DESC, source_id) AS INTEGER) AS rank FROM (
        SELECT target_id, source_id, count(*) AS n, min(coalesce(line, 2147483647)) AS first_line, min((coalesce(line, 2147483647), context)) AS f, (min((coalesce(line, 2147483647), context)))[2] AS first_context FROM refs GROUP BY ALL)) p
    JOIN (SELECT target_id, count(*) AS total, count(*) FILTER (context IN ('code', 'query')) AS uses_metadata, count(*) FILTER (context NOT IN ('code', 'query')) AS refers, count(DISTINCT source_id) AS readers FROM refs GROUP BY 1) k
    ON p.target_id = k.target_id WHERE rank <= 10""", "refs"))
def _(t: Tables) -> DataFrame:
    return graph.usage_summary(t.refs)


@query("a07_rank_routines", sql("SELECT target_id AS id, count(*) AS uses, count(DISTINCT source_id) AS callers FROM edges WHERE kind = 'Calls' AND starts_with(target_id, 'part:') GROUP BY 1 ORDER BY uses DESC, id LIMIT 50", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.rank_routines(t.edges, 50, "part:")


@query("a08_uses_and_sources", sql("SELECT target_id, count(*) AS uses, count(DISTINCT source_id) AS sources FROM edges WHERE kind = 'UsesMetadata' GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return t.edges.where("kind = 'UsesMetadata'").groupBy("target_id").agg(F.count("*").alias("uses"), F.countDistinct("source_id").alias("sources"))


@query("a09_contexts_per_routine", sql("SELECT source_id, string_agg(DISTINCT context, ',' ORDER BY context) AS contexts, count(*) AS n FROM edges WHERE kind = 'UsesMetadata' GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.kinds_of_targets(t.edges)


@query("a10_kinds_per_routine", sql("SELECT source_id, string_agg(split_part(target_id, ':', 1), ',') AS kinds FROM edges WHERE kind = 'UsesMetadata' GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.called_kinds(t.edges)


@query("a11_calls_of_method", sql("SELECT source_id, count(*) AS n FROM edges WHERE kind = 'Calls' AND lower(split_part(detail, '.', -1)) = 'type0' GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.calls_of_method(t.edges, "TYPE0")


@query("a12_module_rating", sql("""SELECT module_path, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT source_id AS id, count(*) AS uses FROM edges WHERE kind = 'Calls' GROUP BY 1 ORDER BY uses DESC, id LIMIT 300)
    JOIN symbols ON id = node_id GROUP BY 1""", "edges", "symbols"))
def _(t: Tables) -> DataFrame:
    top = t.edges.where("kind = 'Calls'").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "id").limit(300)
    return conventions.rate_modules(top, t.symbols)


@query("a13_rights_by_role", sql("SELECT role_id, count(*) AS n, CAST(sum(may_read::INT) + sum(may_insert::INT) AS BIGINT) AS granted, CAST(sum((NOT may_read)::INT) + sum((NOT may_insert)::INT) AS BIGINT) AS denied, count(*) FILTER (has_rls) AS restricted FROM rights GROUP BY 1", "rights"))
def _(t: Tables) -> DataFrame:
    return rights.per_key(t.rights, "role_id", ["may_read", "may_insert"])


@query("a14_condition_totals", sql("SELECT count(*) AS matches, count(DISTINCT role_id) AS roles, count(DISTINCT object_id) AS objects FROM rights WHERE contains(lower(condition), 'the')", "rights"))
def _(t: Tables) -> DataFrame:
    return rights.condition_totals(t.rights, "The")


@query("a15_tree_counts", sql("""SELECT root, kind, count(*) AS n FROM (SELECT p.id AS root, c.kind FROM objects p JOIN objects c ON c.parent_id = p.id WHERE p.parent_id IS NULL
    UNION ALL SELECT p.id, d.kind FROM objects p JOIN objects c ON c.parent_id = p.id JOIN objects d ON d.parent_id = c.id WHERE p.parent_id IS NULL) GROUP BY ALL""", "objects"))
def _(t: Tables) -> DataFrame:
    return graph.tree_counts(t.objects)


@query("a16_child_counters", sql("SELECT parent_id, count(*) FILTER (kind = 'Attribute') AS attributes, count(*) FILTER (kind = 'Form') AS forms, count(*) AS n FROM objects WHERE parent_id IS NOT NULL GROUP BY 1", "objects"))
def _(t: Tables) -> DataFrame:
    return t.objects.where("parent_id is not null").groupBy("parent_id").agg(F.count_if(F.col("kind") == "Attribute").alias("attributes"), F.count_if(F.col("kind") == "Form").alias("forms"), F.count("*").alias("n"))


_HITS = "hits AS (SELECT path, n, line FROM lines WHERE contains(lower(line), 'token'))"


@query("a17_hits_by_owner", sql("SELECT split_part(path, '/', 1) AS owner, count(*) AS n FROM hits GROUP BY 1", "lines", more=_HITS))
def _(t: Tables) -> DataFrame:
    hits = grep.grep(t.texts, "token", per_file=1_000_000)
    owners = t.texts.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("owner"))
    return grep.by_owner(hits, owners)


@query("a18_entry_counts", sql("""SELECT kind, count(id) AS n FROM (VALUES ('Subscription'), ('Job'), ('FormHandler')) k(kind) LEFT JOIN (
    SELECT 'Subscription' AS kind2, event_id AS id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'FormHandler', event_id FROM events WHERE event_type = 'click') e ON kind = kind2 GROUP BY 1"""))
def _(t: Tables) -> DataFrame:
    e = t["events"].select(F.when(F.col("event_type") == "purchase", "Subscription").when(F.col("event_type") == "click", "FormHandler").alias("kind"), "event_id")
    return entrypoints.counts(e.where("kind is not null"))


@query("a19_max_context", sql("SELECT source_id, target_id, max(context) AS context FROM refs GROUP BY ALL", "refs"))
def _(t: Tables) -> DataFrame:
    return t.refs.groupBy("source_id", "target_id").agg(F.max("context").alias("context"))


@query("a20_parse_statistics", "SELECT source, count(*) AS modules, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(regexp_split_to_array(text, '\\r\\n|\\r|\\n'))) AS BIGINT) AS lines FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t["documents"].groupBy("source").agg(F.count("*").alias("modules"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(F.split("text", r"\r\n|\r|\n", -1))).alias("lines"))


# Filters and projections


@query("f01_node", sql("SELECT * FROM nodes WHERE id = 'customer:7'", "nodes"))
def _(t: Tables) -> DataFrame:
    return graph.node(t.nodes, " customer:7 ")


@query("f02_kinds", sql("SELECT id, name FROM nodes WHERE kind IN ('Module', 'Platform')", "nodes"))
def _(t: Tables) -> DataFrame:
    return graph.of_kinds(t.nodes, ["Module", "Platform"]).select("id", "name")


@query("f03_files", sql("SELECT path FROM texts WHERE regexp_matches(lower(path), '(1|3)$') AND (starts_with(path, 'src1/') OR starts_with(path, 'src2/'))", "texts"))
def _(t: Tables) -> DataFrame:
    return grep.file_filter(t.texts.select("path"), ["1", "3"], ["src1/", "src2/"])


@query("f05_sections", sql("SELECT id, kind FROM objects WHERE lower(kind) IN ('form', 'catalog')", "objects"))
def _(t: Tables) -> DataFrame:
    return t.objects.where(F.lower("kind").isin("form", "catalog")).select("id", "kind")


@query("f06_exists", sql("SELECT EXISTS (SELECT 1 FROM nodes WHERE metadata_kind = 'Catalog') AS found", "nodes"))
def _(t: Tables) -> DataFrame:
    return t.nodes.where("metadata_kind = 'Catalog'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("f07_build_options", sql("SELECT kind, count(*) AS n FROM edges e LEFT JOIN nodes x ON e.target_id = x.id WHERE e.kind <> 'Contains' AND NOT coalesce(x.is_external, false) GROUP BY e.kind".replace("SELECT kind", "SELECT e.kind"), "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.counts(graph.build_options(t.edges, t.nodes, containment=False, external=False))


@query("f08_dedup_edges", sql("SELECT kind, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM edges UNION ALL SELECT * FROM edges) WHERE source_id <> target_id) GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.counts(graph.dedup_edges(t.edges.union(t.edges)))


@query("f09_dedup_nodes", sql("SELECT id, 'First' AS kind, name FROM nodes", "nodes"))
def _(t: Tables) -> DataFrame:
    base = t.nodes.select("id", "name")
    twice = base.select("id", F.lit("Later").alias("kind"), "name", F.lit(2).alias("priority")).union(base.select("id", F.lit("First"), "name", F.lit(1)))
    return graph.dedup_nodes(twice).select("id", "kind", "name")


@query("f11_literal_like", sql("SELECT path FROM texts WHERE contains(text, '100%') OR contains(text, '_')", "texts"))
def _(t: Tables) -> DataFrame:
    return t.texts.where(F.contains("text", F.lit("100%")) | F.contains("text", F.lit("_"))).select("path")


@query("f14_id_parts", "SELECT p_partkey, CASE WHEN contains(p_type, '.') THEN split_part(p_type, '.', 1) ELSE '' END AS kind, split_part(p_brand || '/' || p_type, '/', 1) AS top FROM part")
def _(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", names.id_kind("p_type").alias("kind"), names.top_level_id(F.concat("p_brand", F.lit("/"), "p_type")).alias("top"))


# Joins


@query("j01_unresolved", sql("SELECT count(*) AS n FROM edges JOIN nodes ON target_id = id WHERE is_external", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.unresolved(t.edges, t.nodes)


@query("j02_usages", sql("SELECT r.source_id, r.target_id, context, line, detail, name AS reader_name, source_path AS reader_path FROM refs r LEFT JOIN nodes ON id = r.source_id WHERE context = 'code'", "refs", "nodes"))
def _(t: Tables) -> DataFrame:
    return graph.usages(t.refs, t.nodes, context="code")


@query("j03_terms_to_symbols", sql("SELECT node_id, name FROM symbols WHERE contains(lower(comment_head), 'urgent')", "symbols"))
def _(t: Tables) -> DataFrame:
    hits = search.terms(t.symbols.select("node_id", "comment_head"), "node_id", "comment_head").where("term = 'urgent'")
    return t.symbols.join(hits.select(F.col("id").alias("node_id")), "node_id").select("node_id", "name")


@query("j05_entry_objects", sql("SELECT id, name FROM objects o WHERE EXISTS (SELECT 1 FROM refs r WHERE r.target_id = o.id AND context = 'type') OR id = 'nation:3'", "objects", "refs"))
def _(t: Tables) -> DataFrame:
    hit = t.refs.where("context = 'type'").select(F.col("target_id").alias("id")).union(t.spark.sql("select 'nation:3' as id"))
    return t.objects.join(hit, "id", "left_semi").select("id", "name")


@query("j08_module_paths", sql("SELECT DISTINCT e.source_id AS owner_id, n.source_path AS path FROM edges e JOIN nodes n ON e.target_id = n.id WHERE e.kind = 'Contains' AND n.kind = 'Module'", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.module_paths(t.edges, t.nodes)


@query("j09_file_owners", sql("""SELECT coalesce(m.path, o.path) AS path, coalesce(o.id, m.owner_id) AS owner_id FROM (SELECT n.source_path AS path, min(e.source_id) AS owner_id FROM edges e JOIN nodes n ON e.target_id = n.id
    WHERE e.kind = 'Contains' AND n.kind = 'Module' GROUP BY 1) m FULL JOIN (SELECT source_path AS path, min(id) AS id FROM objects WHERE source_path IS NOT NULL AND right(id, 1) = '4' GROUP BY 1) o ON m.path = o.path""", "nodes", "edges", "objects"))
def _(t: Tables) -> DataFrame:
    return graph.file_owners(t.edges, t.nodes, t.objects.where(F.col("id").endswith("4")))


@query("j10_owner_by_prefix", sql("SELECT path, CASE WHEN starts_with(path, 'src1/en/') THEN 'deep' WHEN starts_with(path, 'src1/') THEN 'top' WHEN starts_with(path, 'src2/') THEN 'two' END AS owner FROM texts", "texts"))
def _(t: Tables) -> DataFrame:
    dirs = t.spark.createDataFrame([("src1", "top"), ("src1/en", "deep"), ("src2", "two")], "directory string, owner string")
    return grep.owner_by_prefix(t.texts.select("path"), dirs)


_POINTS = "points AS (SELECT DISTINCT 'customer:' || o_custkey AS module_path, CAST(o_orderkey % 47 AS INTEGER) AS line FROM orders)"


def _points(t: Tables) -> DataFrame:
    return t["orders"].select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("module_path"), (F.col("o_orderkey") % 47).cast("int").alias("line")).distinct()


@query("j12_routine_at_line", sql("SELECT p.module_path, p.line, (SELECT name FROM symbols s WHERE s.module_path = p.module_path AND p.line BETWEEN start_line AND end_line ORDER BY start_line LIMIT 1) AS routine FROM points p", "symbols", more=_POINTS))
def _(t: Tables) -> DataFrame:
    return grep.routine_at(_points(t), t.symbols)


@query("j13_narrowest_routine", sql("SELECT p.module_path, p.line, arg_min(name, (end_line - start_line, start_line)) AS routine FROM points p JOIN symbols s ON s.module_path = p.module_path AND p.line BETWEEN start_line AND end_line GROUP BY ALL", "symbols", more=_POINTS))
def _(t: Tables) -> DataFrame:
    return grep.narrowest_routine(_points(t), t.symbols)


@query("j14_resolve_calls", sql("""SELECT c.caller_path, c.name, coalesce(o.node_id, u.node_id) AS target FROM (SELECT 'customer:' || o_custkey AS caller_path, 'Order' || (o_orderkey + 1) AS name FROM orders) c
    LEFT JOIN symbols o ON o.module_path = c.caller_path AND lower(o.name) = lower(c.name)
    LEFT JOIN (SELECT lower(name) AS k, min(node_id) AS node_id FROM symbols GROUP BY 1 HAVING count(*) = 1) u ON u.k = lower(c.name)""", "symbols"))
def _(t: Tables) -> DataFrame:
    calls = t["orders"].select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("caller_path"), F.concat(F.lit("Order"), (F.col("o_orderkey") + 1).cast("string")).alias("name"))
    return similar.resolve_calls(calls, t.symbols)


@query("j16_caller_sites", sql("""SELECT e.source_id, e.target_id, e.line, coalesce(s.name, n.name) AS caller, coalesce(module_path, source_path) AS path FROM edges e JOIN nodes n ON n.id = e.source_id
    LEFT JOIN symbols s ON s.node_id = e.source_id WHERE e.kind = 'Calls'""", "nodes", "edges", "symbols"))
def _(t: Tables) -> DataFrame:
    return graph.caller_sites(t.edges, t.nodes, t.symbols)


@query("j17_decorate", sql("""SELECT i.id, module_path, start_line, coalesce(uses, 0) AS uses, coalesce(targets, 0) AS targets, first_call, coalesce(contexts, '') AS contexts FROM (SELECT node_id AS id FROM symbols) i
    LEFT JOIN symbols ON node_id = i.id LEFT JOIN (SELECT source_id, count(*) AS uses, count(DISTINCT target_id) AS targets, (min((line, detail)))[2] AS first_call FROM edges WHERE kind = 'Calls' GROUP BY 1) c ON c.source_id = i.id
    LEFT JOIN (SELECT source_id, string_agg(DISTINCT context, ',' ORDER BY context) AS contexts FROM edges WHERE kind = 'UsesMetadata' GROUP BY 1) k ON k.source_id = i.id""", "symbols", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.decorate(t.symbols.select(F.col("node_id").alias("id")), t.edges, t.symbols)


@query("j20_changes", """SELECT coalesce(c.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT 'f' || event_id AS path, user_id AS size, event_id % 7 AS mtime FROM events WHERE event_id % 10 <> 3) k FULL JOIN
    (SELECT 'F' || event_id AS path, user_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS size, event_id % 7 AS mtime FROM events WHERE event_id % 10 <> 4) c ON lower(k.path) = lower(c.path)
    WHERE k.path IS NULL OR c.path IS NULL OR k.size <> c.size OR k.mtime <> c.mtime""")
def _(t: Tables) -> DataFrame:
    e = t["events"]
    known = e.where("event_id % 10 <> 3").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("user_id").alias("size"), (F.col("event_id") % 7).alias("mtime"))
    now = e.where("event_id % 10 <> 4").select(F.concat(F.lit("F"), F.col("event_id").cast("string")).alias("path"), (F.col("user_id") + (F.col("event_id") % 50 == 0).cast("int")).alias("size"), (F.col("event_id") % 7).alias("mtime"))
    return changes.changes(known, now)


@query("s03_overlay", """SELECT path, source_index, overridden FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY source_index DESC) AS r, count(*) OVER (PARTITION BY lower(path)) > 1 AS overridden FROM (
    SELECT 0 AS source_index, 'doc' || doc_id AS path FROM documents UNION ALL SELECT 1, 'Doc' || doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 2, 'DOC' || doc_id FROM documents WHERE doc_id % 5 = 0)) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    d = t["documents"].select("doc_id")
    part = lambda i, name, step: d.where(F.col("doc_id") % step == 0).select(F.lit(i).alias("source_index"), F.concat(F.lit(name), F.col("doc_id").cast("string")).alias("path"))
    return changes.overlay(part(0, "doc", 1).union(part(1, "Doc", 3)).union(part(2, "DOC", 5))).select("path", "source_index", "overridden")


# Sorts, limits, pages, set operations


@query("k01_node_order", sql("SELECT id, kind FROM nodes ORDER BY CASE kind WHEN 'Configuration' THEN 0 WHEN 'MetadataObject' THEN 1 WHEN 'Module' THEN 2 ELSE 3 END, id LIMIT 100", "nodes"))
def _(t: Tables) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(k) for k in graph.KIND_ORDER]), F.col("kind"))
    return t.nodes.orderBy(order, "id").limit(100).select("id", "kind")


@query("k04_edge_order", sql("SELECT source_id, target_id, kind, line, detail FROM edges WHERE target_id = 'supplier:3' ORDER BY kind, line NULLS FIRST, source_id, target_id, detail NULLS FIRST LIMIT 200", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.incoming(t.edges, "supplier:3", limit=200).select("source_id", "target_id", "kind", "line", "detail")


@query("k06_children_page", sql("SELECT id, kind, name, (SELECT count(*) FROM objects WHERE parent_id = 'nation:3') AS total FROM objects WHERE parent_id = 'nation:3' ORDER BY kind, name, id LIMIT 10 OFFSET 5", "objects"))
def _(t: Tables) -> DataFrame:
    return graph.children_page(t.objects, "nation:3", 10, 5)


@query("k07_bounded_page", sql("SELECT parent_id, name, used FROM (SELECT parent_id, name, CAST(sum(length(name)) OVER w AS BIGINT) AS used, count(*) OVER w AS nth FROM objects WHERE parent_id IS NOT NULL WINDOW w AS (PARTITION BY parent_id ORDER BY name, id ROWS UNBOUNDED PRECEDING)) WHERE used <= 100 OR nth = 1", "objects"))
def _(t: Tables) -> DataFrame:
    return graph.bounded_page(t.objects.where("parent_id is not null"), ["parent_id"], ["name", "id"], F.length("name"), 100).select("parent_id", "name", "used")


@query("k08_more_pages", sql("SELECT * FROM (SELECT id, name FROM nodes WHERE kind = 'Platform' ORDER BY name, id LIMIT 20 OFFSET 20), (SELECT count(*) > 40 AS has_more FROM nodes WHERE kind = 'Platform')", "nodes"))
def _(t: Tables) -> DataFrame:
    found = graph.of_kinds(t.nodes, ["Platform"]).select("id", "name").orderBy("name", "id").offset(20).limit(21)
    seen = found.withColumn("r", F.row_number().over(Window.orderBy("name", "id"))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return seen.where("r <= 20").select("id", "name", (F.col("n") > 20).alias("has_more"))


@query("u03_first_of", sql("SELECT name AS k, id, 1 AS stage FROM nodes WHERE kind = 'Platform' UNION ALL SELECT name, id, 2 FROM nodes WHERE kind = 'MetadataObject'", "nodes"))
def _(t: Tables) -> DataFrame:
    a = t.nodes.where("kind = 'Platform'").select(F.col("name").alias("k"), "id", F.lit(1).alias("stage"))
    b = t.nodes.where("kind in ('Platform', 'MetadataObject')").select(F.col("name").alias("k"), "id", F.lit(2).alias("stage"))
    return changes.first_of([a, b], "k")


@query("u04_gone", sql("SELECT id FROM nodes WHERE kind = 'Module' EXCEPT SELECT 'customer:' || o_custkey FROM orders", "nodes"))
def _(t: Tables) -> DataFrame:
    kept = t["orders"].select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("id"))
    return changes.gone(graph.of_kinds(t.nodes, ["Module"]).select("id"), kept, "id")


# Search and text


@query("t01_search_graph", sql("""SELECT id, score, degree FROM (SELECT id, CASE WHEN lower(id) = 'a' THEN 0 WHEN lower(name) = 'a' THEN 1 WHEN starts_with(lower(id), 'a') THEN 3 WHEN starts_with(lower(name), 'a') THEN 4
    WHEN contains(lower(id), 'a') THEN 5 WHEN contains(lower(name), 'a') THEN 6 WHEN contains(lower(metadata_kind), 'a') THEN 7 WHEN contains(lower(source_path), 'a') THEN 9 END AS score FROM nodes) n
    JOIN (SELECT id AS i, (SELECT count(*) FROM edges WHERE target_id = id) + (SELECT count(*) FROM edges WHERE source_id = id) AS degree FROM nodes) ON id = i WHERE score IS NOT NULL ORDER BY score, degree DESC, id LIMIT 30 OFFSET 10""", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return search.search_graph(t.nodes, t.edges, "A", offset=10)


@query("t02_search_index", sql("""SELECT id, name, rank FROM (SELECT id, name, CASE WHEN lower(id) = 'customer' THEN 0 WHEN lower(name) = 'customer' THEN 1 WHEN starts_with(lower(name), 'customer') THEN 2
    WHEN contains(lower(name), 'customer') OR contains(lower(id), 'customer') THEN 4 END AS rank FROM nodes WHERE kind = 'Module') WHERE rank IS NOT NULL ORDER BY rank, length(name), name, id LIMIT 20""", "nodes"))
def _(t: Tables) -> DataFrame:
    return search.search_index(t.nodes, "Customer", kinds=["Module"])


@query("t03_search_nested", sql("""SELECT id, name, rank FROM (SELECT id, name, CASE WHEN lower(name) = 'build' THEN 0 WHEN lower(synonym) = 'build' THEN 1 WHEN starts_with(lower(name), 'build') THEN 2 WHEN starts_with(lower(synonym), 'build') THEN 3
    WHEN contains(lower(name), 'build') THEN 4 WHEN contains(lower(synonym), 'build') THEN 5 END AS rank FROM objects WHERE lower(kind) IN ('form')) WHERE rank IS NOT NULL ORDER BY rank, length(name), name, id LIMIT 20""", "objects"))
def _(t: Tables) -> DataFrame:
    return search.search_nested(t.objects, "build", kinds=["Form"])


@query("t04_search_objects", sql("""SELECT id, name, stage FROM (SELECT id, name, CASE WHEN lower(name) = 'i' OR lower(synonym) = 'i' THEN 0 WHEN starts_with(lower(name), 'i') OR starts_with(lower(synonym), 'i') THEN 1
    WHEN contains(lower(name), 'i') OR contains(lower(synonym), 'i') THEN 2 END AS stage FROM objects) WHERE stage = (SELECT min(CASE WHEN lower(name) = 'i' OR lower(synonym) = 'i' THEN 0 WHEN starts_with(lower(name), 'i') OR starts_with(lower(synonym), 'i') THEN 1
    WHEN contains(lower(name), 'i') OR contains(lower(synonym), 'i') THEN 2 END) FROM objects) ORDER BY length(name), name, id LIMIT 20""", "objects"))
def _(t: Tables) -> DataFrame:
    return search.search_objects(t.objects, "I")


@query("t05_search_symbols", sql("""SELECT node_id, name, stage FROM (SELECT node_id, name, CASE WHEN lower(name) = 'order12' THEN 0 WHEN starts_with(lower(name), 'order12') THEN 1 WHEN contains(lower(name), 'order12') THEN 3 END AS stage FROM symbols)
    WHERE stage IS NOT NULL ORDER BY stage, length(name), name, node_id LIMIT 20""", "symbols"))
def _(t: Tables) -> DataFrame:
    return search.smart_search(t.symbols, "order12")


_BM25 = """w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), s AS (SELECT id, len(w) AS dl, w FROM w), a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s),
    p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS term FROM s) WHERE term IN ('token', 'worthless') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"""


@query("t07_bm25", f"WITH {_BM25} SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN d USING (term), a GROUP BY id")
def _(t: Tables) -> DataFrame:
    return search.bm25(t["documents"], ["token", "Worthless"], "doc_id", "text").select("id", F.round("score", 6).alias("score"))


@query("t08_resolve", sql("SELECT id, 0 AS stage FROM nodes WHERE id = 'nation:4'", "nodes"))
def _(t: Tables) -> DataFrame:
    return search.resolve(t.nodes, t.edges, "nation:4")


@query("t09_callers_by_text", sql("SELECT source_id, target_id, line, detail FROM edges WHERE kind = 'Calls' AND detail = (SELECT min(detail) FROM edges WHERE kind = 'Calls' AND contains(detail, '.'))", "edges"))
def _(t: Tables) -> DataFrame:
    # The texts come from the parts alone; the calls are scanned once.
    called = t["lineitem"].select(F.col("l_partkey").alias("p_partkey"))
    least = t["part"].join(called, "p_partkey", "left_semi").agg(F.min(F.concat("p_brand", F.lit("."), "p_type")).alias("d"))
    return t.edges.where("kind = 'Calls'").join(F.broadcast(least), F.col("detail") == F.col("d")).select("source_id", "target_id", "line", "detail")


@query("t10_grep", sql("""SELECT path, n, line, context FROM (SELECT path, n, line, concat_ws(chr(10), before, line, after) AS context, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM (
    SELECT path, n, line, lag(line) OVER (PARTITION BY path ORDER BY n) AS before, lead(line) OVER (PARTITION BY path ORDER BY n) AS after FROM lines) WHERE contains(lower(line), 'token')) WHERE r <= 10""", "lines"))
def _(t: Tables) -> DataFrame:
    return long(grep.grep(t.texts, "ToKen"), "n")


@query("t10_grep_regex", sql("SELECT path, n, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM lines WHERE regexp_matches(line, '(?i)token = \"[0-9a-f]{8}')) WHERE r <= 2", "lines"))
def _(t: Tables) -> DataFrame:
    return long(grep.grep(t.texts, 'token = "[0-9a-f]{8}', regex=True, per_file=2), "n").select("path", "n", "line")


@query("t11_trigram_candidates", sql("SELECT DISTINCT path FROM texts WHERE contains(lower(text), 'tok') AND contains(lower(text), 'oke') AND contains(lower(text), 'ken')", "texts"))
def _(t: Tables) -> DataFrame:
    return grep.trigram_candidates(grep.trigrams(t.texts, "token"), "token")


@query("t12_grep_decorated", sql("SELECT path, n, split_part(path, '/', 1) AS owner, line FROM hits", "lines", more=_HITS))
def _(t: Tables) -> DataFrame:
    hits = long(grep.grep(t.texts, "token", per_file=1_000_000).select("path", "n", "line"), "n")
    dirs = t["documents"].select(F.col("source").alias("directory"), F.col("source").alias("owner")).distinct()
    return hits.join(grep.owner_by_prefix(hits.select("path").distinct(), dirs), "path").select("path", "n", "owner", "line")


@query("t13_identifier_tokens", "SELECT p_partkey, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(p_brand || 'Of' || p_type, '([^\\p{Lu}])(\\p{Lu})', '\\1 \\2', 'g'), '[_.(),\\s]+', ' ', 'g'))), ' '), lambda x: x <> '') AS tokens FROM part".replace("SELECT p_partkey, ", "SELECT p_partkey, array_to_string(").replace(" AS tokens", ", ',') AS tokens"))
def _(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", F.array_join(text.identifier_tokens(F.concat("p_brand", F.lit("Of"), "p_type")), ",").alias("tokens"))


@query("t14_term_tokens", """SELECT doc_id, string_agg(w, ',' ORDER BY length(w) DESC, w) AS terms FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS r FROM (
    SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '([^\\p{Lu}])(\\p{Lu})', '\\1 \\2', 'g'), '[\\p{L}\\p{N}]+'))) AS w FROM documents) WHERE length(w) >= 3) WHERE r <= 12 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", F.array_join(text.term_tokens("text"), ",").alias("terms")).where("terms <> ''")


@query("t15_call_name", sql("SELECT DISTINCT detail, lower(split_part(detail, '.', -1)) AS name FROM edges WHERE kind = 'Calls'", "edges"))
def _(t: Tables) -> DataFrame:
    return t.edges.where("kind = 'Calls'").select("detail", names.call_name("detail").alias("name")).distinct()


@query("t16_same_stem", """SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey
    WHERE left(lower(a.n_name), greatest(3, least(least(length(a.n_name), length(b.n_name)) - 1, 5))) = left(lower(b.n_name), greatest(3, least(least(length(a.n_name), length(b.n_name)) - 1, 5)))
    AND least(length(a.n_name), length(b.n_name)) >= greatest(3, least(least(length(a.n_name), length(b.n_name)) - 1, 5))""")
def _(t: Tables) -> DataFrame:
    n = t["nation"].select("n_nationkey", "n_name", F.left(F.lower("n_name"), F.lit(3)).alias("k"))
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a"), "k"), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"), "k")
    return a.join(b, "k").where((F.col("i") < F.col("j")) & text.same_stem("a", "b")).select("a", "b")


@query("t18_stems", "SELECT n_name, CASE WHEN length(n_name) >= 6 THEN lower(n_name) || ',' || left(lower(n_name), length(n_name) - 2) ELSE lower(n_name) END AS stems FROM nation")
def _(t: Tables) -> DataFrame:
    return t["nation"].select("n_name", F.array_join(text.stems(F.array(F.lower("n_name"))), ",").alias("stems"))


@query("t19_search_topics")
def _(t: Tables) -> DataFrame:
    topics = t.topics.select(names.topic_name("path").alias("name"), "title", "text")
    return search.search_topics(topics, "the")


@query("s10_topics")
def _(t: Tables) -> DataFrame:
    return t.topics


@query("s11_topic_names", "SELECT page_id, 'pages.' || page_id || '.x' AS name FROM pages")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", names.topic_name(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit("\\x.HTML"))).alias("name"))


@query("t20_find_topics", sql("SELECT lower(p_name) AS alias, min(p_brand || '.' || p_name) AS name FROM part GROUP BY 1"))
def _(t: Tables) -> DataFrame:
    topics = t["part"].select(F.concat("p_brand", F.lit("."), "p_name").alias("name"), F.lit("").alias("title"))
    return search.find_topics(t["part"].select(F.lower("p_name").alias("alias")).distinct(), topics)


@query("t23_rights_detail", sql("SELECT object_id, 'Insert=' || CAST(may_insert AS VARCHAR) || ';Read=' || CAST(may_read AS VARCHAR) || CASE WHEN has_rls THEN ';RLS' ELSE '' END AS detail FROM rights", "rights"))
def _(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("Read"), F.col("may_read"), F.lit("Insert"), F.col("may_insert"))
    return t.rights.select("object_id", names.rights_detail(m, "has_rls").alias("detail"))


@query("t23_parse_rights", sql("SELECT object_id, may_read, has_rls FROM rights", "rights"))
def _(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("Read"), F.col("may_read"), F.lit("Insert"), F.col("may_insert"))
    parsed = t.rights.select("object_id", names.parse_rights(names.rights_detail(m, "has_rls")).alias("p"))
    return parsed.select("object_id", F.col("p.rights")["Read"].alias("may_read"), F.col("p.has_rls").alias("has_rls"))


@query("t31_condition_search", sql("SELECT role_id, object_id FROM rights WHERE contains(lower(condition), 'tion')", "rights"))
def _(t: Tables) -> DataFrame:
    return rights.condition_search(t.rights, "TION").select("role_id", "object_id")


@query("s05_lines", sql("SELECT path, count(*) AS n, max(n) AS last FROM lines GROUP BY 1", "lines"))
def _(t: Tables) -> DataFrame:
    return long(grep.lines(t.texts).groupBy("path").agg(F.count("*").alias("n"), F.max("n").alias("last")), "last")


@query("s17_fragment", sql("""SELECT path, CAST(least(3, total) AS INTEGER) AS first, CAST(least(greatest(5, least(3, total)), total) AS INTEGER) AS last, CAST(total AS INTEGER) AS total, array_to_string(a[least(3, total):least(greatest(5, least(3, total)), total)], chr(10)) AS text
    FROM (SELECT path, a, len(a) AS total FROM (SELECT path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM texts))""", "texts"))
def _(t: Tables) -> DataFrame:
    return grep.fragment(t.texts, 3, 5)


# Domain analytics

_REACH = """walk(id, depth) AS (SELECT 'order:1', 0 UNION SELECT CASE WHEN e.source_id = w.id THEN e.target_id ELSE e.source_id END, depth + 1 FROM walk w JOIN small e ON e.source_id = w.id OR e.target_id = w.id WHERE depth < 2)"""


@query("c08_reach", sql("SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1", "edges", more="small AS (SELECT DISTINCT source_id, target_id FROM edges WHERE kind = 'Calls')," + _REACH, recursive=True))
def _(t: Tables) -> DataFrame:
    return graph.reach(t.edges, t.spark.sql("select 'order:1' as id"), 2, "both", ["Calls"])


@query("c09_neighborhood", sql("SELECT source_id, target_id, kind, line, detail FROM edges WHERE kind IN ('Contains', 'Defines') AND source_id IN (SELECT id FROM walk) AND target_id IN (SELECT id FROM walk)", "edges",
    more="walk(id, depth) AS (SELECT 'nation:3', 0 UNION SELECT e.target_id, depth + 1 FROM walk w JOIN edges e ON e.source_id = w.id WHERE depth < 2 AND kind IN ('Contains', 'Defines'))", recursive=True))
def _(t: Tables) -> DataFrame:
    return graph.neighborhood(t.edges, t.spark.sql("select 'nation:3' as id"), 2, "out", ["Contains", "Defines"])


@query("c10_callers", sql("SELECT DISTINCT source_id FROM edges WHERE kind = 'Calls' AND target_id = 'part:7'", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.callers(t.edges, "part:7")


@query("c10_callees", sql("SELECT DISTINCT target_id FROM edges WHERE kind = 'Calls' AND source_id = 'order:7'", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.callees(t.edges, "order:7")


@query("c11_cards", sql("""SELECT n.id, n.kind, n.name, coalesce(no, 0) AS n_outgoing, coalesce(ni, 0) AS n_incoming, coalesce(o, '') AS outgoing, coalesce(i, '') AS incoming FROM nodes n
    LEFT JOIN (SELECT source_id, max(c) AS no, string_agg(kind || ' ' || target_id, ';' ORDER BY r) FILTER (r <= 5) AS o FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS c, row_number() OVER (PARTITION BY source_id ORDER BY kind, line NULLS FIRST, target_id, detail NULLS FIRST) AS r FROM edges) GROUP BY 1) x ON x.source_id = n.id
    LEFT JOIN (SELECT target_id, max(c) AS ni, string_agg(kind || ' ' || source_id, ';' ORDER BY r) FILTER (r <= 5) AS i FROM (SELECT *, count(*) OVER (PARTITION BY target_id) AS c, row_number() OVER (PARTITION BY target_id ORDER BY kind, line NULLS FIRST, source_id, detail NULLS FIRST) AS r FROM edges) GROUP BY 1) y ON y.target_id = n.id
    WHERE n.kind IN ('MetadataObject', 'Module', 'Platform')""", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.cards(graph.of_kinds(t.nodes, ["MetadataObject", "Module", "Platform"]), t.edges, 5)


@query("c12_tree_cards", sql("""SELECT p.id, string_agg(c.kind || ' ' || c.id || ' ' || coalesce(k.n, 0), ';' ORDER BY c.kind, c.id) AS children FROM objects p JOIN objects c ON c.parent_id = p.id
    LEFT JOIN (SELECT parent_id, count(*) AS n FROM objects GROUP BY 1) k ON k.parent_id = c.id WHERE p.parent_id IS NULL GROUP BY 1""", "objects"))
def _(t: Tables) -> DataFrame:
    told = F.transform("children", lambda c: F.concat_ws(" ", c["kind"], c["id"], F.size(c["items"]).cast("string")))
    return graph.tree_cards(t.objects).select("id", F.array_join(told, ";").alias("children"))


@query("c13_usages_of_object", sql("SELECT r.source_id, r.target_id, context, line, detail, name AS reader_name, source_path AS reader_path FROM refs r LEFT JOIN nodes ON id = r.source_id WHERE r.target_id = 'supplier:3' AND context = 'query'", "refs", "nodes"))
def _(t: Tables) -> DataFrame:
    return graph.usages(t.refs, t.nodes, "supplier:3", "query")


@query("c14_references_of", sql("SELECT target_id, context, line FROM refs WHERE source_id = 'order:9'", "refs"))
def _(t: Tables) -> DataFrame:
    return t.refs.where("source_id = 'order:9'").select("target_id", "context", "line")


_WEIGHTED = """fw AS (SELECT category, value, count(*) AS rows, count(DISTINCT id) AS holders, (SELECT count(DISTINCT id) FROM features) AS a FROM features GROUP BY ALL),
    rare AS (SELECT category, value, ln(a / holders) AS weight FROM fw WHERE rows < greatest(32, a // 50)), drafts AS (SELECT * FROM features WHERE id % 50 = 0)"""


@query("c16_candidates", sql("""SELECT d.id AS draft, f.id, f.category, count(*) AS shared, round(sum(r.weight), 6) AS gained, any_value(s.size) AS size FROM drafts d JOIN rare r USING (category, value)
    JOIN features f ON f.category = d.category AND f.value = d.value AND f.id <> d.id JOIN (SELECT id, category, count(DISTINCT value) AS size FROM features GROUP BY ALL) s ON s.id = f.id AND s.category = f.category GROUP BY d.id, f.id, f.category""", "features", more=_WEIGHTED))
def _(t: Tables) -> DataFrame:
    f = t.features
    out = similar.candidates(f, f.where("id % 50 = 0"))
    return out.select("draft", "id", "category", "shared", F.round("gained", 6).alias("gained"), "size")


_SCORED = _WEIGHTED + """, whole AS (SELECT d.id AS draft, category, sum(weight) AS most FROM drafts d JOIN rare USING (category, value) GROUP BY ALL),
    met AS (SELECT d.id AS draft, f.id, f.category, count(*) AS shared, sum(r.weight) AS gained FROM drafts d JOIN rare r USING (category, value) JOIN features f ON f.category = d.category AND f.value = d.value AND f.id <> d.id GROUP BY d.id, f.id, f.category),
    sizes AS (SELECT id, category, count(DISTINCT value) AS size FROM features GROUP BY ALL), cw AS (SELECT * FROM (VALUES ('call', 0.40), ('name', 0.14)) c(category, w)),
    sums AS (SELECT m.draft, m.id, sum(w * gained / most * least(1.0, sqrt(shared / size))) AS raw FROM met m JOIN whole USING (draft, category) JOIN sizes s ON s.id = m.id AND s.category = m.category JOIN cw ON cw.category = m.category GROUP BY ALL),
    present AS (SELECT draft, sum(w) AS present FROM whole JOIN cw USING (category) GROUP BY 1), shape AS (SELECT doc_id AS id, len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS lines, length(text) AS statements FROM documents),
    scored AS (SELECT s.draft, s.id, b.lines, least(1.0, raw / present) * (1 - 0.1 * (0.7 * abs(a.lines - b.lines) / greatest(a.lines, b.lines) + 0.3 * CASE WHEN greatest(a.statements, b.statements) > 0 THEN abs(a.statements - b.statements) / greatest(a.statements, b.statements) ELSE 0 END)) AS score
      FROM sums s JOIN present USING (draft) JOIN shape a ON a.id = s.draft JOIN shape b ON b.id = s.id)"""


@query("c18_similar", sql("SELECT draft, id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY draft ORDER BY round(score, 9) DESC, lines, id) AS INTEGER) AS rank FROM scored WHERE score >= 0.05) WHERE rank <= 10", "features", more=_SCORED))
def _(t: Tables) -> DataFrame:
    f = t.features
    shape = t["documents"].select(F.col("doc_id").alias("id"), F.size(F.split("text", r"\r\n|\r|\n", -1)).alias("lines"), F.length("text").alias("statements"))
    return similar.score(f, f.where("id % 50 = 0"), shape).select("draft", "id", F.round("score", 6).alias("score"), "rank")


@query("c20_intents", """SELECT question, intent, score, words FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, words DESC, ord) AS r FROM (
    SELECT question, intent, ord, CAST(sum(points) AS BIGINT) AS score, count(DISTINCT asked) AS words FROM (SELECT q.n_name AS question, r.r_name AS intent, r.r_regionkey AS ord, lower(q.n_name) AS asked, max(CASE WHEN r.r_regionkey % 2 = 0 THEN 4 ELSE 2 END) AS points
    FROM nation q JOIN region r ON left(lower(q.n_name), 3) = left(lower(r.r_name), 3) AND least(length(q.n_name), length(r.r_name)) >= greatest(3, least(least(length(q.n_name), length(r.r_name)) - 1, 5))
      AND left(lower(q.n_name), greatest(3, least(least(length(q.n_name), length(r.r_name)) - 1, 5))) = left(lower(r.r_name), greatest(3, least(least(length(q.n_name), length(r.r_name)) - 1, 5))) GROUP BY ALL) GROUP BY ALL)) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    q = t["nation"].select(F.col("n_name").alias("question"), F.col("n_name").alias("word"))
    i = t["region"].select(F.col("r_name").alias("intent"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("word"), (F.col("r_regionkey") % 2 == 0).alias("strong"))
    return conventions.recognise(q, i)


@query("c21_score_routines", sql("""SELECT id, score FROM (SELECT s.node_id AS id, CAST(4 * coalesce(m.n, 0) + 3 * coalesce(k.n, 0) + 3 * contains(lower(name), '77')::INT + 2 * contains(lower(comment_head), 'urgent')::INT AS INTEGER) AS score FROM symbols s
    LEFT JOIN (SELECT source_id, count(DISTINCT lower(split_part(detail, '.', -1))) AS n FROM edges WHERE kind = 'Calls' AND lower(split_part(detail, '.', -1)) IN ('type0', 'type1') GROUP BY 1) m ON m.source_id = node_id
    LEFT JOIN (SELECT source_id, count(DISTINCT context) AS n FROM edges WHERE context = 'code' GROUP BY 1) k ON k.source_id = node_id) WHERE score > 0""", "symbols", "edges").replace("contains(lower(name), '77')::INT", "(contains(lower(name), '77')::INT + contains(lower(name), 'urgent')::INT)").replace("contains(lower(comment_head), 'urgent')::INT", "(contains(lower(comment_head), 'urgent')::INT + contains(lower(comment_head), '77')::INT)"))
def _(t: Tables) -> DataFrame:
    calls = t.edges.where("kind = 'Calls'").groupBy("source_id").agg(F.collect_set(names.call_name("detail")).alias("calls"))
    kinds = t.edges.where("kind = 'UsesMetadata'").groupBy("source_id").agg(F.collect_set("context").alias("kinds"))
    none = F.expr("cast(array() as array<string>)")
    e = t.symbols.join(calls, F.col("node_id") == calls.source_id, "left").drop("source_id").join(kinds, F.col("node_id") == kinds.source_id, "left")
    rows = e.select(F.col("node_id").alias("id"), "name", "comment_head", F.coalesce("calls", none).alias("calls"), F.coalesce("kinds", none).alias("kinds"))
    return conventions.score_routines(rows, ["type0", "type1"], ["code"], ["77", "urgent"])


@query("c22_platform_matches", sql("SELECT source_id AS id, count(*) AS n FROM edges WHERE kind = 'Calls' AND lower(split_part(detail, '.', -1)) = 'type1' AND split_part(detail, '.', 1) <> 'Brand#1' GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return conventions.platform_matches(t.edges, "Type1", t.spark.sql("select 'Brand#1' as name"))


@query("c25_entry_points", sql("""SELECT f.kind, f.id, s.node_id AS routine_id, s.node_id IS NOT NULL AS is_resolved FROM (SELECT 'Subscription' AS kind, 'e' || event_id AS id, 'customer:' || (user_id % 100) AS m, 'Order' || event_id AS p FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'FormHandler', 'e' || event_id, 'customer:' || (user_id % 100), 'Order' || event_id FROM events WHERE event_type = 'click') f LEFT JOIN symbols s ON s.module_path = f.m AND s.name = f.p""", "symbols"))
def _(t: Tables) -> DataFrame:
    e = t["events"].select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("object_id"), F.col("event_type").alias("event"), F.concat(F.lit("customer:"), (F.col("user_id") % 100).cast("string")).alias("module_path"), F.concat(F.lit("Order"), F.col("event_id").cast("string")).alias("procedure"))
    subs, forms = e.where("event = 'purchase'").withColumn("kind", F.lit("Subscription")), e.where("event = 'click'").withColumn("kind", F.lit("FormHandler"))
    return entrypoints.collect([subs, forms], t.symbols).select("kind", "id", "routine_id", "is_resolved")


@query("c26_check_calls", """WITH s AS (SELECT 'p' || p_brand AS module, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'Function' ELSE 'Procedure' END AS kind, p_size % 3 <> 0 AS is_export, min(p_size % 4) AS required, min(p_size % 4 + 2) AS total FROM part WHERE p_partkey % 5 <> 0 AND p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_name) GROUP BY ALL),
    c AS (SELECT l_orderkey, l_linenumber AS line, 'p' || p_brand AS qualifier, p_name AS name, CAST(l_quantity AS INTEGER) % 7 AS args, l_linestatus = 'O' AS used FROM lineitem JOIN part ON p_partkey = l_partkey),
    m AS (SELECT c.*, s.kind, s.is_export, s.required, s.total FROM c LEFT JOIN s ON s.module = c.qualifier AND s.name = c.name)
    SELECT rule, severity, count(*) AS n FROM (SELECT 'unknown-method' AS rule, 'error' AS severity FROM m WHERE kind IS NULL AND qualifier IN (SELECT module FROM s) UNION ALL SELECT 'argument-count', 'error' FROM m WHERE args < required OR args > total
    UNION ALL SELECT 'not-exported', 'error' FROM m WHERE NOT is_export UNION ALL SELECT 'procedure-as-function', 'error' FROM m WHERE kind = 'Procedure' AND used UNION ALL SELECT 'function-as-procedure', 'warning' FROM m WHERE kind = 'Function' AND NOT used) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    p = t["part"]
    first = p.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey")
    s = p.where("p_partkey % 5 <> 0").join(first, "p_partkey", "left_semi").select(F.concat(F.lit("p"), F.col("p_brand")).alias("module"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "Function").otherwise("Procedure").alias("kind"), (F.col("p_size") % 3 != 0).alias("is_export"), (F.col("p_size") % 4).alias("required"), (F.col("p_size") % 4 + 2).alias("total"))
    c = t["lineitem"].join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.lit("p"), F.col("p_brand")).alias("qualifier"), F.col("p_name").alias("name"), (F.col("l_quantity").cast("int") % 7).alias("args"), (F.col("l_linestatus") == "O").alias("used"))
    return check.check_calls(c, s).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("c26_unknown_objects", sql("SELECT source_id, target_id FROM refs WHERE target_id NOT IN (SELECT id FROM objects WHERE id <> 'nation:3')", "refs", "objects"))
def _(t: Tables) -> DataFrame:
    return check.unknown_objects(t.refs, t.objects.where("id <> 'nation:3'")).select("source_id", "target_id")


@query("c26_similar_names", """WITH n AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_partkey % 7 = 0 UNION SELECT lower(n_name) FROM nation)
    SELECT a.n AS name, b.n AS hint, CAST(levenshtein(a.n, b.n) AS INTEGER) AS d FROM n a JOIN n b ON levenshtein(a.n, b.n) BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY a.n ORDER BY d, b.n) <= 3""")
def _(t: Tables) -> DataFrame:
    n = t["part"].where("p_partkey % 7 = 0").select(F.col("p_name").alias("name")).union(t["nation"].select("n_name"))
    return check.similar_names(n, n)


@query("c27_rights_of_role", sql("SELECT role_id, object_id, may_read, may_insert, has_rls FROM rights WHERE lower(role_id) = 'src3'", "rights"))
def _(t: Tables) -> DataFrame:
    return rights.of_role(t.rights, "SRC3")


@query("c33_partial_reindex", sql("SELECT source_id, target_id, kind, line FROM edges WHERE kind = 'Calls'", "edges"))
def _(t: Tables) -> DataFrame:
    calls = t.edges.where("kind = 'Calls'").select("source_id", "target_id", "kind", "line")
    scope = t["orders"].where("o_orderkey % 7 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source_id"))
    stale = calls.withColumn("line", F.when(F.substring_index("source_id", ":", -1).cast("long") % 7 == 0, F.lit(-1)).otherwise(F.col("line")))
    return changes.replace_rows(stale, calls.join(scope, "source_id", "left_semi").select(*calls.columns), "source_id", scope)
