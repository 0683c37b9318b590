"""Queries over module code, names and help made from the test tables, and the same questions as SQL.

``Tables.modules`` writes code by a rule from the orders; the SQL works the answer out from the same orders, so what the
patterns read back from the text is checked against what was put in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import helptext, names, text
from .operators import changes, check, conventions, entrypoints, graph, grep, rights, search, similar
from .plans import build, code, tokens, types
from .plans.driver import Tables, sql
from .plans.settle import shared_folder
from .plans.tokens import Scan
from .registry import query
from .sources import inverted

#: Number of the order in a module path or routine name, for SQL.
_HELP = "VALUES ('Нет1'), ('Нет4'), ('Массив.Добавить')"


# Routines, calls, variables


@query("c02_routines", sql("SELECT path, name, CASE WHEN is_function THEN 'Function' ELSE 'Procedure' END AS kind, is_export, base + 3 AS start_line, base + 11 AS end_line, 2 AS total, 1 AS required, 'Первый,Второй' AS parameters FROM code", "code"))
def _(t: Tables) -> DataFrame:
    return code.routines(t.modules).select("path", "name", "kind", "is_export", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "total", "required", F.array_join("parameters", ",").alias("parameters"))


_CALLS = """calls AS (SELECT path, name AS routine, base + 5 AS line, CAST(NULL AS VARCHAR) AS qualifier, name AS method, CASE WHEN k % 5 = 0 THEN 3 ELSE 2 END AS args, false AS used, k, module, is_function, is_export FROM code
    UNION ALL SELECT path, name, base + 6, 'Справочники.C' || (k % 7), 'Найти', 1, true, k, module, is_function, is_export FROM code
    UNION ALL SELECT path, name, base + 8, NULL, 'Нет' || (k % 11), 1, false, k, module, is_function, is_export FROM code WHERE k % 4 = 0
    UNION ALL SELECT path, name, base + 8, module, name, 1, true, k, module, is_function, is_export FROM code WHERE k % 4 <> 0)"""


@query("c02_call_sites", sql("SELECT path, routine, line, qualifier, method, args, used FROM calls", "code", more=_CALLS))
def _(t: Tables) -> DataFrame:
    m = t.modules
    found = code.call_sites(m, None)
    return found.withColumn("line", F.col("line").cast("int"))


_DECLARED = """declared AS (SELECT path, name AS routine, 'Итог' AS name, base + 4 AS line, is_function AND k % 6 <> 0 AS is_read, k FROM code
    UNION ALL SELECT path, name, 'Дата', base + 6, k % 4 = 0, k FROM code UNION ALL SELECT path, name, 'Запрос', base + 7, k % 4 <> 0, k FROM code
    UNION ALL SELECT path, name, 'Дальше', base + 8, false, k FROM code WHERE k % 4 <> 0 UNION ALL SELECT path, name, 'Лишний', base + 10, false, k FROM code WHERE k % 6 = 1)"""


@query("c06_declared", sql("SELECT path, routine, name, line FROM declared", "code", more=_DECLARED))
def _(t: Tables) -> DataFrame:
    m = t.modules
    return code.declared(m, None).withColumn("line", F.col("line").cast("int"))


@query("c28_visible_names", sql("SELECT c.path, c.base + 7 AS line, d.name FROM code c JOIN declared d ON d.path = c.path AND d.routine = c.name AND d.line <= c.base + 7 UNION ALL SELECT path, base + 7, unnest(['Первый', 'Второй']) FROM code", "code", more=_DECLARED))
def _(t: Tables) -> DataFrame:
    m = t.modules
    scan = Scan(m, "header", "assigned")
    points = scan.routines.select("path", (F.col("start_line") + 4).alias("line"))
    return code.visible(points, m, scan.routines, scan).withColumn("line", F.col("line").cast("int"))


@query("c07_inferred_types", sql("SELECT path, name AS routine, 'Итог' AS name, base + 4 AS line, CASE WHEN k % 3 = 0 THEN 'Структура' ELSE 'Массив' END AS type FROM code", "code"))
def _(t: Tables) -> DataFrame:
    m = t.modules
    return code.inferred_types(m, None).withColumn("line", F.col("line").cast("int"))


@query("w05_last_types", sql("""SELECT path, name AS routine, 'Итог' AS name, CASE WHEN is_function AND k % 6 <> 0 OR NOT is_function AND k % 6 = 1 THEN CASE WHEN k % 3 = 0 THEN 'Структура' ELSE 'Массив' END END AS type FROM code
    UNION ALL SELECT path, routine, name, NULL FROM declared WHERE name <> 'Итог'""", "code", more=_DECLARED))
def _(t: Tables) -> DataFrame:
    m = t.modules
    return code.last_types(m, None)


@query("c04_query_tables", sql("SELECT path, name AS routine, base + 7 AS line, 'Document.D' || (k % 4) AS target_id, 'query' AS context FROM code", "code"))
def _(t: Tables) -> DataFrame:
    scan = Scan(t.modules)
    return code.query_tables(scan.texts, scan.routines).withColumn("line", F.col("line").cast("int"))


@query("c05_metadata_access", sql("SELECT path, name AS routine, base + 6 AS line, 'Catalog.C' || (k % 7) AS target_id, 'code' AS context FROM code", "code"))
def _(t: Tables) -> DataFrame:
    m = t.modules
    return code.accesses(m, None).withColumn("line", F.col("line").cast("int"))


@query("w03_comment_heads", sql("SELECT path, base + 3 AS n, '// ' || priority AS comment_head FROM code", "code"))
def _(t: Tables) -> DataFrame:
    scan = Scan(t.modules)
    starts = scan.routines.select("path", F.col("start_line").alias("n"))
    return grep.comment_heads(grep.lines(scan.texts), starts).withColumn("n", F.col("n").cast("int"))


@query("c26_draft_check", sql("""SELECT path, line, rule, severity, name FROM (
    SELECT path, line, CASE WHEN method LIKE 'Нет%' THEN 'unknown-routine' END AS rule, 'error' AS severity, method AS name FROM calls WHERE qualifier IS NULL
    UNION ALL SELECT path, line, 'argument-count', 'error', method FROM calls WHERE qualifier IS NULL AND args = 3
    UNION ALL SELECT path, line, 'function-as-procedure', 'info', method FROM calls WHERE qualifier IS NULL AND method LIKE 'Order%' AND is_function
    UNION ALL SELECT path, line, 'procedure-as-function', 'error', method FROM calls WHERE qualifier = module AND NOT is_function
    UNION ALL SELECT path, base + 3, 'unused-parameter', 'warning', 'Второй' FROM code
    UNION ALL SELECT path, base + 3, 'function-without-return', 'error', name FROM code WHERE is_function AND k % 6 = 0
    UNION ALL SELECT path, base + 10, 'code-after-return', 'warning', name FROM code WHERE k % 6 = 1) WHERE rule IS NOT NULL""", "code", more=_CALLS + ",\n" + _DECLARED))
def _(t: Tables) -> DataFrame:
    return check.draft(t.modules).withColumn("line", F.col("line").cast("int"))


# The same over irregular code


@query("c01_token_kinds", sql("""SELECT path, base + i AS n, kinds FROM (SELECT path, base, unnest(range(1, 13)) AS i, unnest([CASE WHEN k % 2 = 0 THEN 'd' END, 'a', 'kcoco', 'kcolocoolo' || CASE WHEN is_export THEN 'k' ELSE '' END, 'kcoco', 'cococololoo', 'lococooocololololoo',
    'col', 'l', 'lococoo', 'kcolkcocok' || CASE WHEN k % 13 = 2 THEN '' WHEN is_function THEN 'kco' ELSE 'ko' END || 'ko', CASE WHEN k % 7 = 1 THEN 'kocolo' END]) AS kinds FROM script) WHERE kinds IS NOT NULL""", "script"))
def _(t: Tables) -> DataFrame:
    kinds = tokens.token_lines(t.scripts).select("path", "n", F.array_join("tokens.kind", "").alias("kinds"), F.col("tokens")[0]["text"].alias("first"))
    # The lines of a routine up to the one that not all have: they begin with these words, and no later line does.
    late = F.col("first").isin("Справочники.C0.Найти", "КонецФункции", "КонецПроцедуры", "#КонецЕсли", "Итог", ")") | F.col("first").rlike(r"^(Справочники|M[0-9])")
    return kinds.where(~late).select("path", F.col("n").cast("int").alias("n"), "kinds")


@query("c02_irregular_calls", sql("SELECT path, routine, line, qualifier, method, args, used, nested FROM said", "script"))
def _(t: Tables) -> DataFrame:
    return Scan(t.scripts).calls().select("path", "routine", F.col("line").cast("int").alias("line"), "qualifier", "method", "args", "used", "nested")


@query("c02_irregular_routines", sql("""SELECT path, name, CASE WHEN is_function THEN 'Function' ELSE 'Procedure' END AS kind, is_export, base + 3 AS start_line,
    CASE WHEN k % 17 <> 0 THEN base + size - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END WHEN after IS NULL THEN total ELSE base + size + 3 END AS end_line, 3 AS total, 1 AS required, 'Первый,Второй,Третий' AS parameters FROM script""", "script"))
def _(t: Tables) -> DataFrame:
    return code.routines(t.scripts).select("path", "name", "kind", "is_export", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "total", "required", F.array_join("parameters", ",").alias("parameters"))


@query("c06_resolved_names", sql("""SELECT path, base + 7 AS line, name, kind, line AS declared FROM (
    SELECT path, base, 'ТРЕТИЙ' AS name, 'Parameter' AS kind, base + 3 AS line FROM script UNION ALL SELECT path, base, 'счет', 'Local', base + 5 FROM script
    UNION ALL SELECT path, base, 'Итог', CASE WHEN k % 4 = 1 THEN 'Local' END, CASE WHEN k % 4 = 1 THEN at9 + CASE WHEN k % 9 IN (4, 5) THEN 2 ELSE 1 END END FROM script
    UNION ALL SELECT path, base, name, 'Routine', base + 3 FROM script)""", "script"))
def _(t: Tables) -> DataFrame:
    scan = Scan(t.scripts, "header", "assigned")
    asked = F.explode(F.array(F.lit("ТРЕТИЙ"), F.lit("счет"), F.lit("Итог"), F.col("name")))
    points = scan.routines.select("path", (F.col("start_line") + 4).alias("line"), asked.alias("asked"))
    out = code.resolve_names(points.select("path", "line", F.col("asked").alias("name")), scan)
    return out.select("path", F.col("line").cast("int").alias("line"), "name", "kind", F.col("declared").cast("int").alias("declared"))


@query("c26_irregular_draft", sql("""SELECT DISTINCT path, line, rule, severity, name FROM (
    SELECT path, line, 'unknown-routine' AS rule, 'error' AS severity, method AS name FROM said WHERE qualifier IS NULL AND method NOT IN ('Сообщить') AND method NOT LIKE 'Order%'
    UNION ALL SELECT s.path, line, 'procedure-as-function', 'error', method FROM said s JOIN script c USING (k) WHERE method = c.name AND (qualifier IS NULL OR qualifier = c.module) AND used AND NOT is_function
    UNION ALL SELECT path, line, 'argument-count', 'error', method FROM said WHERE args = 4
    UNION ALL SELECT s.path, line, 'function-as-procedure', 'info', method FROM said s JOIN script c USING (k) WHERE args = 4 AND is_function
    UNION ALL SELECT s.path, line, 'function-as-procedure', 'info', method FROM said s JOIN script c USING (k) WHERE k % 9 = 4 AND qualifier = 'M' || fcust AND line > c.at9 AND ff
    UNION ALL SELECT s.path, line, 'not-exported', 'error', method FROM said s JOIN script c USING (k) WHERE k % 9 = 4 AND qualifier = 'M' || fcust AND line > c.at9 AND NOT fe AND cust <> fcust
    UNION ALL SELECT path, line, 'unknown-method', 'error', method FROM said WHERE method = 'Нет'
    UNION ALL SELECT path, at3 + 1, 'unknown-metadata', 'error', 'Catalog.C' || (k % 7) FROM script WHERE k % 3 = 0 AND k % 7 >= 5
    UNION ALL SELECT path, base + 3, 'unused-parameter', 'warning', 'Третий' FROM script WHERE k % 3 <> 0
    UNION ALL SELECT path, base + 5, 'unused-variable', 'warning', 'Лишний' FROM script
    UNION ALL SELECT path, base + 3, 'function-without-return', 'error', name FROM script WHERE is_function AND k % 13 = 2 AND k % 7 <> 1
    UNION ALL SELECT path, base + 12, 'code-after-return', 'warning', name FROM script WHERE k % 7 = 1)""", "script"))
def _(t: Tables) -> DataFrame:
    objects = t["region"].select(F.concat(F.lit("Catalog.C"), F.col("r_regionkey").cast("string")).alias("id"))
    known = t.spark.sql("select 'сообщить' as name")
    return check.draft(t.scripts, objects, known).withColumn("line", F.col("line").cast("int"))


@query("j14_irregular_stages", sql("""SELECT path, routine, line, CASE stage WHEN 0 THEN 'routine:module:' || path || '#' || method WHEN 1 THEN 'routine:module:CommonModules/' || qualifier || '/Ext/Module.bsl#' || method WHEN 2 THEN 'routine:module:CommonModules/' || substr(qualifier, 14) || '/Ext/Module.bsl#' || method
    WHEN 3 THEN 'Platform.Сообщить' WHEN 4 THEN 'Platform.Массив.Добавить' ELSE CASE WHEN qualifier IS NULL THEN 'call:CommonModule.' || split_part(path, '/', 2) || '.' || method ELSE 'call:' || qualifier || '.' || method END END AS target_id, stage FROM (
    SELECT *, CASE WHEN qualifier IS NULL AND method LIKE 'Order%' THEN 0 WHEN qualifier LIKE 'M%' AND method LIKE 'Order%' THEN 1 WHEN qualifier LIKE 'CommonModule.%' THEN 2 WHEN method = 'Сообщить' THEN 3 WHEN method = 'Добавить' THEN 4 ELSE 5 END AS stage FROM said WHERE NOT nested)""", "script"))
def _(t: Tables) -> DataFrame:
    m = t.scripts
    scan = Scan(m, "header", "call", **tokens.TYPED)
    topics = t.spark.sql("select * from values ('Сообщить'), ('Массив.Добавить') t(name)")
    out = build.resolve(code.calls(m, scan.routines, scan, nested=False), scan.routines, topics, code.last_types(m, scan.routines, scan))
    return out.select("path", "routine", F.col("line").cast("int").alias("line"), "target_id", "stage")


@query("a22_problems_by_severity", sql("SELECT 'warning' AS severity, count(*) AS n FROM code WHERE k % 6 = 1 UNION ALL SELECT 'error', count(*) FROM code WHERE is_function AND k % 6 = 0", "code"))
def _(t: Tables) -> DataFrame:
    m = t.modules
    scan = Scan(m, "late", header=tokens.DRAFT["header"])
    told = code.after_return(scan).select(F.lit("warning").alias("severity")).union(code.functions_without_return(scan).select(F.lit("error")))
    return check.by_severity(told)


@query("j14_resolution_stages", sql(f"""SELECT path, routine, line, CASE WHEN qualifier IS NULL AND method LIKE 'Order%' OR qualifier = module THEN 'routine:module:' || path || '#' || method WHEN method IN ({_HELP.replace("VALUES ", "").replace("(", "").replace(")", "")}) THEN 'Platform.' || method
    WHEN qualifier IS NULL THEN 'call:CommonModule.' || module || '.' || method ELSE 'call:' || qualifier || '.' || method END AS target_id,
    CASE WHEN qualifier IS NULL AND method LIKE 'Order%' THEN 0 WHEN qualifier = module THEN 1 WHEN method IN ({_HELP.replace("VALUES ", "").replace("(", "").replace(")", "")}) THEN 3 ELSE 5 END AS stage FROM calls""", "code", more=_CALLS))
def _(t: Tables) -> DataFrame:
    m = t.modules
    scan = Scan(m, "header", "call", **tokens.TYPED)
    found = scan.routines
    topics = t.spark.sql(f"select * from {_HELP} t(name)")
    out = build.resolve(code.calls(m, found, scan), found, topics, code.last_types(m, found, scan))
    return out.select("path", "routine", F.col("line").cast("int").alias("line"), "target_id", "stage")


@query("t12_grep_code", sql("SELECT path, base + 6 AS n, 'CommonModule.' || module AS owner, name AS routine, CASE WHEN k2 % 3 = 0 THEN 1 ELSE 0 END AS source_index, k2 % 3 = 0 AS overridden FROM (SELECT *, CAST(substr(module, 2) AS BIGINT) AS k2 FROM code) WHERE k % 7 = 3", "code"))
def _(t: Tables) -> DataFrame:
    scan = Scan(t.modules)
    m = scan.texts
    found = scan.routines.select(F.col("path").alias("module_path"), "name", "start_line", "end_line")
    hits = grep.grep(m, "Справочники.C3.", per_file=1_000_000).select("path", "n", "line")
    paths = m.select("path")
    third = paths.where(F.regexp_extract("path", r"/M(\d+)/", 1).cast("long") % 3 == 0)
    layers = paths.select(F.lit(0).alias("source_index"), "path").union(third.select(F.lit(1), "path"))
    owners = paths.select("path", build.owner_of_path("path").alias("owner"))
    out = grep.decorated(hits, owners, found, layers)
    return out.select("path", F.col("n").cast("int").alias("n"), "owner", "routine", "source_index", "overridden")


@query("j06_module_text", sql("SELECT path, count(*) AS tf FROM code WHERE k % 3 = 0 GROUP BY 1", "code"))
def _(t: Tables) -> DataFrame:
    found = search.terms(t.modules, "path", "text").where("term = 'структура'")
    return found.select(F.col("id").alias("path"), "tf")


@query("c15_routine_features", sql("""SELECT category, value, count(DISTINCT (path, routine)) AS routines FROM (SELECT path, routine, 'call' AS category, lower(method) AS value FROM calls UNION ALL SELECT path, name, 'metadata', 'Catalog.C' || (k % 7) FROM code
    UNION ALL SELECT path, name, 'query', 'Document.D' || (k % 4) FROM code UNION ALL SELECT path, name, 'name', lower(name) FROM code) GROUP BY ALL""", "code", more=_CALLS))
def _(t: Tables) -> DataFrame:
    m = t.modules
    scan = Scan(m, "header", "call", "access")
    found = scan.routines
    f = similar.routine_features(code.calls(m, found, scan), code.accesses(m, found, scan), code.query_tables(scan.texts, found), found)
    return f.groupBy("category", "value").agg(F.countDistinct("path", "routine").alias("routines"))


@query("c17_profiles", sql("SELECT id, category, count(*) AS n, array_to_string(list_sort(list(value))[1:3], ',') AS examples FROM features GROUP BY ALL", "features"))
def _(t: Tables) -> DataFrame:
    return similar.profiles(t.features, 3).select("id", "category", "n", F.array_join("examples", ",").alias("examples"))


@query("c07_propagated_types", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    f AS (SELECT o_custkey, k, i, 'Тип' || (k % 3) AS type, 0 AS round FROM o WHERE k % 4 = 0
      UNION ALL SELECT o.o_custkey, o.k, o.i, f.type, f.round + 1 FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1 WHERE o.k % 4 <> 0 AND f.round < 3)
    SELECT 'CommonModules/M' || o_custkey || '/Ext/Module.bsl' AS path, 'P' || k AS routine, unnest(['А', 'Б', 'в']) AS name, type, CAST(round AS INTEGER) AS round FROM f""")
def _(t: Tables) -> DataFrame:
    return types.propagated_types(Scan(t.chains, "header", **tokens.SOURCES))


# The stored inverted index


_INDEXES: dict[tuple[str, str, str], str] = {}


def _stored(t: Tables, kind: str) -> inverted.Inverted:
    """The index of the texts of a folder: built by the first query that asks for it in a session, read by all."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, kind)
    if key not in _INDEXES:
        root = f"{shared_folder(t.spark)}/inverted-{kind}-{uuid.uuid4().hex}"
        inverted.write_inverted(t.texts, root, (kind,))
        _INDEXES[key] = root
    return inverted.Inverted(t.spark, _INDEXES[key])


@query("t11_stored_candidates", sql("SELECT path FROM texts WHERE contains(lower(text), 'wor') AND contains(lower(text), 'ort') AND contains(lower(text), 'rth') AND contains(lower(text), 'thl') AND contains(lower(text), 'hle') AND contains(lower(text), 'les') AND contains(lower(text), 'ess')", "texts"))
def _(t: Tables) -> DataFrame:
    index = _stored(t, "gram")
    return index.texts().join(index.holding("Worthless"), "doc_no", "left_semi").select("path")


@query("t10_stored_grep", sql("SELECT path, n, line FROM (SELECT path, n, line, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM lines WHERE contains(lower(line), 'worthless')) WHERE r <= 10", "lines"))
def _(t: Tables) -> DataFrame:
    return _stored(t, "gram").grep("worthLESS").select("path", F.col("n").cast("long").alias("n"), "line")


@query("j06_stored_text", sql("SELECT path, length(text) AS signs, sha256(text) AS digest FROM texts WHERE path = (SELECT min(path) FROM texts)", "texts"))
def _(t: Tables) -> DataFrame:
    index = _stored(t, "term")
    return index.text_of(t.texts.agg(F.min("path")).first()[0]).select("path", F.length("text").cast("long").alias("signs"), F.sha2("text", 256).alias("digest"))


@query("t07_prefix_search", sql("""SELECT path, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN (SELECT word, count(*) AS df FROM h GROUP BY 1) USING (word), (SELECT count(*) AS n, avg(dl) AS avgdl FROM w) 
    WHERE path IN (SELECT path FROM h GROUP BY 1 HAVING count(*) = 3) GROUP BY 1""", "texts", more="""w AS (SELECT path, words, coalesce(len(words), 0) AS dl FROM (SELECT path, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM texts)),
    h AS (SELECT path, dl, i AS word, len(list_filter(words, lambda x: starts_with(x, p))) AS tf FROM w, (VALUES (0, 'tok'), (1, 'th'), (2, 'an')) q(i, p) WHERE len(list_filter(words, lambda x: starts_with(x, p))) > 0)"""))
def _(t: Tables) -> DataFrame:
    return _stored(t, "term").search("Tok* (th) an.AN").select("path", F.round("score", 6).alias("score"))


_SMART = r"""held AS (SELECT node_id, name, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(name || ' ' || coalesce(comment_head, ''), '([^\p{Lu}])(\p{Lu})', '\1 \2', 'g')), '[_.(),\s]+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM symbols),
    h AS (SELECT node_id, name, len(t) AS dl, i AS word, len(list_filter(t, lambda x: starts_with(x, p))) AS tf FROM held, (VALUES (0, 'urg'), (1, 'ord')) q(i, p) WHERE len(list_filter(t, lambda x: starts_with(x, p))) > 0),
    s AS (SELECT node_id, name, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM h JOIN (SELECT word, count(*) AS df FROM h GROUP BY 1) USING (word), (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM held)
      WHERE node_id IN (SELECT node_id FROM h GROUP BY 1 HAVING count(*) = 2) GROUP BY ALL)"""


@query("t06_first_stage_terms", sql("SELECT node_id, name, 2 AS stage FROM s ORDER BY round(score, 9) DESC, length(name), name, node_id LIMIT 20", "symbols", more=_SMART))
def _(t: Tables) -> DataFrame:
    return search.first_stage_search(t.symbols, "URG ord")


@query("t06_first_stage_prefix", sql("SELECT node_id, name, 1 AS stage FROM symbols WHERE starts_with(lower(name), 'order12') AND lower(name) <> 'order12' ORDER BY length(name), name, node_id LIMIT 20", "symbols"))
def _(t: Tables) -> DataFrame:
    return search.first_stage_search(t.symbols.where("lower(name) <> 'order12'"), "Order12")


# Names and paths


@query("f12_references", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Catalog|' || replace(p_brand, '#', '') || '|' WHEN 1 THEN 'Document|' || replace(p_brand, '#', '') || '|Form.List' END AS parsed FROM part""")
def _(t: Tables) -> DataFrame:
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    n = F.col("p_size") % 4
    told = F.when(n == 0, F.concat(F.lit("cfg:CatalogRef."), brand)).when(n == 1, F.concat(F.lit("DocumentObject."), brand, F.lit(".Form.List"))).when(n == 2, F.concat(F.lit("Nothing."), brand)).otherwise("CatalogRef.")
    r = t["part"].select("p_partkey", names.reference(told).alias("r"))
    return r.select("p_partkey", F.when(F.col("r").isNotNull(), F.concat_ws("|", "r.kind", "r.name", F.coalesce("r.rest", F.lit("")))).alias("parsed"))


@query("t27_module_kinds", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ObjectModule' WHEN 1 THEN 'CommonModule' WHEN 2 THEN 'FormModule' WHEN 3 THEN 'HTTPServiceModule' ELSE 'Unknown' END AS kind,
    CASE o_orderkey % 5 WHEN 4 THEN 'Other.bsl' WHEN 2 THEN 'Main' ELSE 'A' || o_custkey END AS display FROM orders""")
def _(t: Tables) -> DataFrame:
    a = F.concat(F.lit("A"), F.col("o_custkey").cast("string"))
    n = F.col("o_orderkey") % 5
    path = F.when(n == 0, F.concat(F.lit("Catalogs/"), a, F.lit("/Ext/ObjectModule.bsl"))).when(n == 1, F.concat(F.lit("CommonModules/"), a, F.lit("/Ext/Module.bsl")))
    path = path.when(n == 2, F.concat(F.lit("Documents/"), a, F.lit("/Forms/Main/Ext/Form/Module.bsl"))).when(n == 3, F.concat(F.lit("HTTPServices/"), a, F.lit("/Ext/Module.bsl"))).otherwise(F.concat(F.lit("Reports/"), a, F.lit("/Other.bsl")))
    return t["orders"].select("o_orderkey", names.module_kind(path).alias("kind"), names.module_display(path).alias("display"))


@query("t29_event_names", "SELECT event_type, CASE event_type WHEN 'click' THEN 'ПриИзменении' WHEN 'purchase' THEN 'ОбработкаПроведения' END AS handler, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    event = F.when(F.col("event_type") == "click", "onchange").when(F.col("event_type") == "purchase", "Posting").otherwise(F.col("event_type"))
    return t["events"].select("event_type", names.event_name(event).alias("handler")).groupBy("event_type", "handler").agg(F.count("*").alias("n"))


@query("f14_id_names", "SELECT p_partkey, CASE WHEN contains(p_type, '.') THEN regexp_replace(p_type, '^[^.]*\\.', '') ELSE p_type END AS name FROM part")
def _(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", names.id_name("p_type").alias("name"))


@query("s19_places", "SELECT l_orderkey, l_linenumber, l_linenumber AS line, 'CommonModule.M' || l_suppkey AS module FROM lineitem WHERE l_partkey % 10 = 0")
def _(t: Tables) -> DataFrame:
    place = F.concat(F.lit("{CommonModule.M"), F.col("l_suppkey").cast("string"), F.lit("("), F.col("l_linenumber").cast("string"), F.lit(",3)}: text"))
    return t["lineitem"].where("l_partkey % 10 = 0").select("l_orderkey", "l_linenumber", names.place_line(place).cast("long").alias("line"), names.place_module(place).alias("module")).withColumn("line", F.col("line").cast(t["lineitem"].schema["l_linenumber"].dataType))


@query("t24_properties", "SELECT s_suppkey, '{\"Key\":\"' || s_suppkey || '\",\"Name\":\"' || s_name || '\"}' AS properties FROM supplier")
def _(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("Name"), F.col("s_name"), F.lit("Blank"), F.lit(" "), F.lit("Key"), F.col("s_suppkey").cast("string"), F.lit("None"), F.lit(None).cast("string"))
    return t["supplier"].select("s_suppkey", names.properties_json(m).alias("properties"))


@query("t17_question_words", "SELECT o_orderkey, array_to_string(list_filter(list_distinct(['how', lower(o_orderpriority[3:]), 'do', 'order']), lambda x: x NOT IN ('how', 'do') AND NOT contains(x, ' ')), ',') AS words FROM orders WHERE o_orderpriority NOT LIKE '% %'".replace("array_to_string(list_filter(list_distinct(", "array_to_string(list_sort(list_filter(list_distinct(").replace("NOT contains(x, ' ')), ','", "NOT contains(x, ' '))), ','"))
def _(t: Tables) -> DataFrame:
    q = F.concat(F.lit("How "), F.substring("o_orderpriority", 3, 100), F.lit(" do, Order? order"))
    found = t["orders"].where("o_orderpriority not like '% %'").select("o_orderkey", text.question_words(q, ["how", "do"]).alias("w"))
    return found.select("o_orderkey", F.array_join(F.sort_array("w"), ",").alias("words"))


# Help


_BOUNDS = """SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN NULL ELSE CAST(p_size % 3 AS INTEGER) END AS required, CASE WHEN p_size % 5 = 4 THEN NULL ELSE CAST(p_size % 3 + p_size % 2 AS INTEGER) END AS total FROM part"""


@query("t21_parameter_bounds", _BOUNDS)
def _(t: Tables) -> DataFrame:
    one = lambda word, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i <= n, F.concat(F.lit("<P"), i.cast("string"), F.lit(f"> ({word}) Тип: Строка. ")))), "")
    n = F.col("p_size")
    page = F.concat(F.when(n % 5 == 4, "Вариант синтаксиса: по строке ").otherwise(""), F.lit("Синтаксис: F(...) Параметры: "), one("обязательный", n % 3), one("необязательный", n % 2))
    return t["part"].select("p_partkey", helptext.parameter_bounds(page).alias("b")).select("p_partkey", "b.required", "b.total")


@query("t22_builtin_names", "SELECT 'function' AS kind, lower(n_name) AS name FROM nation UNION ALL SELECT 'type', lower(r_name) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def _(t: Tables) -> DataFrame:
    r = t["region"].select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    global_ = t["nation"].select(F.concat(F.lit("Global context."), F.col("n_name")).alias("name"))
    typed = t["nation"].join(r, "n_regionkey").select(F.concat("r_name", F.lit("."), "n_name"))
    return helptext.builtin_names(global_.union(typed), "Global context")


@query("t20_members", "SELECT n_name AS type, r_name AS member, n_regionkey = r_regionkey AS found FROM nation, region")
def _(t: Tables) -> DataFrame:
    topics = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.upper("n_name"), F.lit("."), "r_name").alias("name"))
    asked = t["nation"].select(F.col("n_name").alias("type")).crossJoin(F.broadcast(t["region"].select(F.col("r_name").alias("member"))))  # 25 by 5 rows
    return helptext.members(asked, topics)


# Graph and metadata


@query("w04_first_calls", sql("SELECT target_id, (min((line, source_id, detail)))[2] AS source_id, (min((line, source_id, detail)))[1] AS line, (min((line, source_id, detail)))[3] AS detail FROM edges WHERE kind = 'Calls' GROUP BY 1", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.first_calls(t.edges)


@query("w08_platform_ranks", sql("SELECT * FROM (SELECT source_id, target_id, n, CAST(row_number() OVER (PARTITION BY source_id ORDER BY n DESC, target_id) AS INTEGER) AS rank FROM (SELECT source_id, target_id, count(*) AS n FROM edges WHERE kind = 'UsesMetadata' GROUP BY ALL)) WHERE rank <= 3", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.call_ranks(t.edges, t.nodes, edge_kind="UsesMetadata").select("source_id", "target_id", "n", "rank")


@query("j15_ranked_owners", sql("""SELECT r.id, uses, callers, name, module_path, e.source_id AS owner_id FROM (SELECT target_id AS id, count(*) AS uses, count(DISTINCT source_id) AS callers FROM c GROUP BY 1 ORDER BY uses DESC, id LIMIT 40) r
    LEFT JOIN symbols ON node_id = r.id LEFT JOIN edges e ON e.kind = 'Contains' AND e.target_id = module_path""", "edges", "symbols", more="c AS (SELECT DISTINCT 'order:' || (l_orderkey % 50) AS target_id, 'order:' || l_orderkey AS source_id FROM lineitem)"))
def _(t: Tables) -> DataFrame:
    own = t["lineitem"].select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("order:"), (F.col("l_orderkey") % 50).cast("string")).alias("target_id")).distinct()
    kept = t.edges.where("kind <> 'Calls'").select("source_id", "target_id", "kind")
    return graph.ranked_with_owner(kept.union(own.withColumn("kind", F.lit("Calls"))), t.symbols, 40)


@query("k05_callers_page", sql("SELECT DISTINCT source_id FROM edges WHERE kind = 'Calls' AND target_id = 'part:3' ORDER BY source_id LIMIT 7", "edges"))
def _(t: Tables) -> DataFrame:
    return graph.callers(t.edges, "part:3", 7)


@query("t25_type_info", sql("""SELECT id, string_agg(target_id, ',' ORDER BY r) AS types FROM (SELECT id, target_id, row_number() OVER (PARTITION BY id ORDER BY stage, target_id) AS r FROM (SELECT id, target_id, min(stage) AS stage FROM (
    SELECT o.id, f.target_id, 0 AS stage FROM objects o JOIN f ON f.source_id = o.id UNION ALL SELECT o.id, f.target_id, 1 FROM objects o JOIN f ON f.source_id = o.parent_id AND contains(f.detail, o.name)) GROUP BY ALL)) WHERE r <= 8 GROUP BY 1""", "objects",
    more="f AS (SELECT DISTINCT 'customer:' || o_custkey AS source_id, 'p:' || o_orderpriority AS target_id, CAST(NULL AS VARCHAR) AS detail FROM orders UNION ALL SELECT 'nation:' || c_nationkey, 's:' || c_mktsegment, 'Attribute ' || c_name || ' type' FROM customer WHERE c_custkey % 2 = 0)"))
def _(t: Tables) -> DataFrame:
    ident = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    own = t["orders"].select(ident("customer:", "o_custkey").alias("source_id"), ident("p:", "o_orderpriority").alias("target_id"), F.lit(None).cast("string").alias("detail")).distinct()
    of_owner = t["customer"].where("c_custkey % 2 = 0").select(ident("nation:", "c_nationkey"), ident("s:", "c_mktsegment"), F.concat(F.lit("Attribute "), "c_name", F.lit(" type")))
    return graph.type_info(t.objects, own.union(of_owner).withColumn("context", F.lit("type")))


@query("j07_event_handlers", "SELECT o_custkey AS form_id, 'item' || (o_orderkey % 9) AS name, o_orderpriority AS event, 'P' || o_orderkey AS procedure FROM orders WHERE o_orderkey % 9 IN (SELECT c_custkey % 9 FROM customer WHERE c_custkey % 9 < 5)")
def _(t: Tables) -> DataFrame:
    models = t["orders"].select(F.col("o_custkey").alias("form_id"), F.concat(F.lit("item"), (F.col("o_orderkey") % 9).cast("string")).alias("name"), F.col("o_orderpriority").alias("event"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("procedure"))
    signs = t["customer"].where("c_custkey % 9 < 5").select(F.concat(F.lit("ITEM"), (F.col("c_custkey") % 9).cast("string")).alias("name")).distinct()
    items = t["orders"].select(F.col("o_custkey").alias("form_id")).distinct().crossJoin(F.broadcast(signs))  # five rows
    return check.event_handlers(items, models)


@query("k09_entry_page", "SELECT kind, id, n > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS r, count(*) OVER (PARTITION BY kind) AS n FROM (SELECT event_type AS kind, 'e' || event_id AS id FROM events)) WHERE r <= 20")
def _(t: Tables) -> DataFrame:
    points = t["events"].select(F.col("event_type").alias("kind"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit("x").alias("event"))
    return entrypoints.page(points, 20).select("kind", "id", "truncated")


@query("c27_rights_on_object", sql("SELECT role_id, may_read, has_rls FROM rights WHERE object_id = (SELECT min(object_id) FROM rights)", "rights"))
def _(t: Tables) -> DataFrame:
    least = t["labels"].join(t["documents"].select("doc_id"), "doc_id", "left_semi").agg(F.min(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))).first()[0]
    return rights.on_object(t.rights, least).select("role_id", "may_read", "has_rls")


@query("c23_routines_by_prefix", sql("SELECT node_id FROM symbols WHERE starts_with(lower(name), 'order1') OR starts_with(lower(name), 'order77')", "symbols"))
def _(t: Tables) -> DataFrame:
    return conventions.routines_by_prefix(t.symbols, ["Order1", "ORDER77"]).select("node_id")


@query("j21_module_info", sql("SELECT p.path, n.id AS module_id, e.source_id AS owner_id FROM (SELECT 'BUILDING/' || c_name || '.bsl' AS path FROM customer WHERE c_custkey % 4 = 0) p LEFT JOIN nodes n ON n.source_path = p.path AND n.kind = 'Module' LEFT JOIN edges e ON e.target_id = n.id AND e.kind = 'Contains'", "nodes", "edges"))
def _(t: Tables) -> DataFrame:
    changed = t["customer"].where("c_custkey % 4 = 0").select(F.concat(F.lit("BUILDING/"), "c_name", F.lit(".bsl")).alias("path"))
    return changes.module_info(changed, t.nodes, t.edges)


@query("c33_repaired_calls", sql("""SELECT source_id, target_id, line FROM (SELECT source_id, CASE WHEN CAST(split_part(target_id, ':', 2) AS BIGINT) % 10 = 0 THEN 'call:' || detail ELSE target_id END AS target_id, line FROM edges WHERE kind = 'Calls')""", "edges"))
def _(t: Tables) -> DataFrame:
    calls = t.edges.where("kind = 'Calls'").select("source_id", "target_id", "line", "detail")
    lost = t["part"].where("p_partkey % 10 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return changes.repair_calls(calls, lost).select("source_id", "target_id", "line")


@query("m02_partial_gate", "SELECT count(*) <= 0.2 * (SELECT count(*) FROM orders) AS allowed FROM orders WHERE o_orderkey % 6 = 0")
def _(t: Tables) -> DataFrame:
    path = F.concat(F.lit("M"), F.col("o_orderkey").cast("string"), F.lit(".bsl"))
    known = t["orders"].select(path.alias("path"), F.lit(1).alias("size"), F.lit(1).alias("mtime"))
    now = t["orders"].select(path.alias("path"), F.when(F.col("o_orderkey") % 6 == 0, 2).otherwise(1).alias("size"), F.lit(1).alias("mtime"))
    return changes.gate(changes.changes(known, now), known)
