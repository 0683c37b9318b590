"""Projections of the relational test tables into the canonical frames that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """The tables of one folder as frames; every property is lazy and reads only the columns it names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def nodes(self) -> DataFrame:
        none = F.lit(None).cast("string")

        def part(table: str, prefix: str, key: str, kind: str, name, path=none, metadata=none, external: bool = False) -> DataFrame:  # noqa: ANN001
            return self[table].select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("source_path"), metadata.alias("metadata_kind"), F.lit(external).alias("is_external"))

        frames = [
            part("region", "region", "r_regionkey", "Configuration", F.col("r_name")),
            part("nation", "nation", "n_nationkey", "MetadataObject", F.col("n_name"), metadata=F.lit("Catalog")),
            part("customer", "customer", "c_custkey", "Module", F.col("c_name"), path=F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".bsl"))),
            part("orders", "order", "o_orderkey", "Routine", F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"))),
            part("supplier", "supplier", "s_suppkey", "Platform", F.col("s_name")),
            part("part", "part", "p_partkey", "External", F.col("p_name"), metadata=F.col("p_brand"), external=True),
        ]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    @property
    def edges(self) -> DataFrame:
        none, no_line = F.lit(None).cast("string"), F.lit(None).cast("int")
        ident = lambda prefix, key: F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))

        def plain(table: str, source, target, kind: str, context=none) -> DataFrame:  # noqa: ANN001
            return self[table].select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), no_line.alias("line"), none.alias("detail"), context.alias("context"))

        parts = self["part"].select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("."), "p_type").alias("detail"))
        items = self["lineitem"]
        calls = items.join(parts, "l_partkey").select(ident("order", "l_orderkey").alias("source_id"), ident("part", "l_partkey").alias("target_id"), F.lit("Calls").alias("kind"), F.col("l_linenumber").alias("line"), "detail", none.alias("context"))
        uses = items.select(ident("order", "l_orderkey").alias("source_id"), ident("supplier", "l_suppkey").alias("target_id"), F.lit("UsesMetadata").alias("kind"), F.col("l_linenumber").alias("line"), none.alias("detail"), F.when(F.col("l_linestatus") == "O", "code").otherwise("query").alias("context"))
        return (
            plain("nation", ident("region", "n_regionkey"), ident("nation", "n_nationkey"), "Contains")
            .unionByName(plain("customer", ident("nation", "c_nationkey"), ident("customer", "c_custkey"), "Contains"))
            .unionByName(plain("orders", ident("customer", "o_custkey"), ident("order", "o_orderkey"), "Defines"))
            .unionByName(calls)
            .unionByName(uses)
            .unionByName(plain("supplier", ident("supplier", "s_suppkey"), ident("nation", "s_nationkey"), "References", F.lit("type")))
        )

    @property
    def refs(self) -> DataFrame:
        return self.edges.where("kind in ('UsesMetadata', 'References')").select("source_id", "target_id", "context", "line", "detail")

    @property
    def symbols(self) -> DataFrame:
        """Orders as routines of their customer's module, ten lines each."""
        nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        rows = self["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", nth.alias("nth"))
        return rows.select(
            F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("module_path"),
            F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderstatus") == "F", "Function").otherwise("Procedure").alias("kind"),
            (F.col("o_orderstatus") != "P").alias("is_export"), (F.col("nth") * 10 - 9).alias("start_line"), (F.col("nth") * 10).alias("end_line"), F.col("o_orderpriority").alias("comment_head"),
        )

    @property
    def objects(self) -> DataFrame:
        """Region, nation and customer as a tree of objects."""
        none = F.lit(None).cast("string")
        region = self["region"].select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("Subsystem").alias("kind"), F.col("r_name").alias("name"), F.lower("r_name").alias("synonym"), none.alias("parent_id"), none.alias("source_path"))
        nation = self["nation"].select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), F.lit("Catalog"), "n_name", F.concat(F.lit("The "), F.col("n_name")), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")), none)
        customer = self["customer"].select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 3 == 0, "Form").otherwise("Attribute"), "c_name", F.col("c_mktsegment"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")), F.concat("c_mktsegment", F.lit("/"), "c_name", F.lit(".bsl")))
        return region.union(nation).union(customer)

    @property
    def texts(self) -> DataFrame:
        return self["documents"].select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")

    @property
    def modules(self) -> DataFrame:
        """Customers as common modules ``(path, text)``, each order a routine of twelve lines."""
        k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
        function = F.col("o_orderstatus") == "F"
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        number = lambda n: (k % n).cast("string")
        body = F.array(
            text("// ", F.col("o_orderpriority")),
            F.lit("&НаСервере"),
            text(F.when(function, "Функция").otherwise("Процедура"), " Order", key, "(Первый, Знач Второй = 1)", F.when(F.col("o_orderstatus") != "P", " Экспорт").otherwise("")),
            text("    Итог = Новый ", F.when(k % 3 == 0, "Структура").otherwise("Массив"), ";"),
            text("    Order", key, F.when(k % 5 == 0, "(1, Первый, 3);").otherwise("(1, Первый);")),
            text("    Дата = Справочники.C", number(7), ".Найти(Первый);"),
            text('    Запрос = "ВЫБРАТЬ * ИЗ Документ.D', number(4), ' КАК Т";'),
            F.when(k % 4 == 0, text("    Нет", number(11), "(Дата);")).otherwise(text("    Дальше = M", F.col("o_custkey").cast("string"), ".Order", key, "(Запрос);")),
            F.when(function & (k % 6 != 0), "    Возврат Итог;").when(~function & (k % 6 == 1), "    Возврат;").otherwise("    Итог = Неопределено;"),
            F.when(k % 6 == 1, "    Лишний = 2;").otherwise(""),
            F.when(function, "КонецФункции").otherwise("КонецПроцедуры"),
            F.lit(""),
        )
        rows = self["orders"].select("o_custkey", "o_orderkey", F.array_join(body, "\n").alias("t"))
        packed = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "t"))).alias("a"))
        return packed.select(F.concat(F.lit("CommonModules/M"), F.col("o_custkey").cast("string"), F.lit("/Ext/Module.bsl")).alias("path"), F.array_join(F.transform("a", lambda s: s["t"]), "\n").alias("text"))

    @property
    def scripts(self) -> DataFrame:
        """Customers as common modules of irregular code ``(path, text)``: headers, calls and strings over several lines, calls
        in arguments, several statements a line, directives, dates, comments with brackets, stray and missing ends."""
        k, key, module = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
        function, other = F.col("o_orderstatus") == "F", F.concat(F.lit("M"), F.col("f.cust").cast("string"))
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        number = lambda n: (k % n).cast("string")
        back = F.when(k % 13 == 2, "").when(function, "Возврат Счет; ").otherwise("Возврат; ")
        body = F.array(
            F.when(k % 2 == 0, '#Если Сервер Тогда // "').otherwise('// x("'),
            F.lit("&НаСервере"),
            text(F.when(function, "Функция").otherwise("Процедура"), " Order", key, '(Первый, // первый "('),
            text('    Знач Второй = "a(b,c)", Третий = -1)', F.when(F.col("o_orderstatus") != "P", " Экспорт").otherwise("")),
            F.lit("    Перем Счет, Лишний;"),
            text("    Счет = Внешний", number(11), "(Order", key, '(1, "x;(""y"")"),'),
            text("        '2024(0101', Общий(Первый)); Order", key, "(1, 2, 3, 4);"),
            F.lit('    Текст = "ВЫБРАТЬ * // нет ('),
            text("    |ИЗ Документ.D", number(4), ' КАК ""Т"" ГДЕ Ф(1)'),
            F.lit('    |"; Сообщить(Текст); // Сообщить(1)'),
            text("    Если Счет > 1 И M", module, ".Order", key, "(Второй) Тогда ", back, "КонецЕсли;"),
            F.when(k % 7 == 1, "    Возврат; Счет = 2;"),
            F.when(k % 3 == 0, text("    Справочники.C", number(7), ".Найти(Третий[Счет + 1]).Метод(")),
            F.when(k % 3 == 0, "    );"),
            F.when(k % 9 == 4, text("    ", other, ".Order", F.col("f.k").cast("string"), "(1);")),
            F.when(k % 9 == 5, text("    ", other, ".Нет(1);")),
            F.when(k % 4 == 1, text("    Итог = Новый Массив; Итог.Добавить(1); CommonModule.", other, ".Order", F.col("f.k").cast("string"), "(2);")),
            F.when(k % 17 != 0, F.when(function, "КонецФункции").otherwise("КонецПроцедуры")),
            F.when((k % 17 != 0) & (k % 5 == 0), "КонецПроцедуры"),
            F.when(k % 2 == 0, "#КонецЕсли"),
        )
        first = self["orders"].agg(F.min(F.struct(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"))).alias("f"))
        rows = self["orders"].select("o_custkey", "o_orderkey", "o_orderstatus").crossJoin(F.broadcast(first))  # one row
        rows = rows.select("o_custkey", "o_orderkey", F.array_join(F.array_compact(body), "\n").alias("t"))
        packed = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "t"))).alias("a"))
        return packed.select(F.concat(F.lit("CommonModules/M"), F.col("o_custkey").cast("string"), F.lit("/Ext/Module.bsl")).alias("path"), F.array_join(F.transform("a", lambda s: s["t"]), "\n").alias("text"))

    @property
    def chains(self) -> DataFrame:
        """Customers as modules whose routines pass a variable on to the next routine; every fourth order creates an object."""
        key = F.col("o_orderkey").cast("string")
        after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        body = F.array(
            text("Процедура P", key, "(Лишний, А)"),
            F.when(F.col("o_orderkey") % 4 == 0, text("    А = Новый Тип", (F.col("o_orderkey") % 3).cast("string"), ";")),
            F.lit("    в = Б.Скопировать(); Б = А; Г = А + 1; Круг = Обход; Обход = Круг;"),
            F.when(F.col("after").isNotNull(), text("    Если Истина Тогда P", F.col("after").cast("string"), "(Г, // дальше (\n        В); КонецЕсли;")),
            F.lit("КонецПроцедуры"),
        )
        rows = self["orders"].select("o_custkey", "o_orderkey", after.alias("after")).select("o_custkey", "o_orderkey", F.array_join(F.array_compact(body), "\n").alias("t"))
        packed = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "t"))).alias("a"))
        return packed.select(F.concat(F.lit("CommonModules/M"), F.col("o_custkey").cast("string"), F.lit("/Ext/Module.bsl")).alias("path"), F.array_join(F.transform("a", lambda s: s["t"]), "\n").alias("text"))

    @property
    def rights(self) -> DataFrame:
        docs = self["documents"].select("doc_id", F.col("source").alias("role_id"), F.col("text").alias("condition"))
        joined = self["labels"].join(docs, "doc_id")
        return joined.select("role_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("object_id"), (F.col("quality") == 1).alias("may_read"), (F.col("toxic") == 1).alias("may_insert"), (F.col("quality") == 0).alias("has_rls"), "condition")

    @property
    def topics(self) -> DataFrame:
        from ..functions.text import plain_topic

        t = plain_topic("html")
        return self["pages"].select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), t.alias("t")).select("path", "t.title", "t.text")

    @property
    def features(self) -> DataFrame:
        """Documents as routines; their different longer words are call features, the very long ones names."""
        words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 9))
        rows = self["documents"].select(F.col("doc_id").alias("id"), F.explode(words).alias("value"))
        return rows.select("id", F.when(F.length("value") >= 14, "name").otherwise("call").alias("category"), "value")


# The same projections as SQL for the oracle.
_NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Configuration' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS source_path, CAST(NULL AS VARCHAR) AS metadata_kind, false AS is_external FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'MetadataObject', n_name, NULL, 'Catalog', false FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Module', c_name, c_mktsegment || '/' || c_name || '.bsl', NULL, false FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'Routine', 'Order' || o_orderkey, NULL, NULL, false FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Platform', s_name, NULL, NULL, false FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'External', p_name, NULL, p_brand, true FROM part)"""
_EDGES = """edges AS (
  SELECT 'region:' || n_regionkey AS source_id, 'nation:' || n_nationkey AS target_id, 'Contains' AS kind, CAST(NULL AS INTEGER) AS line, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS context FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains', NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'Defines', NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'Calls', l_linenumber, p_brand || '.' || p_type, NULL FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'UsesMetadata', l_linenumber, NULL, CASE WHEN l_linestatus = 'O' THEN 'code' ELSE 'query' END FROM lineitem
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'References', NULL, NULL, 'type' FROM supplier)"""
_REFS = "refs AS (SELECT source_id, target_id, context, line, detail FROM edges WHERE kind IN ('UsesMetadata', 'References'))"
_SYMBOLS = """symbols AS (
  SELECT 'order:' || o_orderkey AS node_id, 'customer:' || o_custkey AS module_path, 'Order' || o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'Function' ELSE 'Procedure' END AS kind,
    o_orderstatus <> 'P' AS is_export, CAST(nth * 10 - 9 AS INTEGER) AS start_line, CAST(nth * 10 AS INTEGER) AS end_line, o_orderpriority AS comment_head
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders))"""
_OBJECTS = """objects AS (
  SELECT 'region:' || r_regionkey AS id, 'Subsystem' AS kind, r_name AS name, lower(r_name) AS synonym, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS source_path FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Catalog', n_name, 'The ' || n_name, 'region:' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Form' ELSE 'Attribute' END, c_name, c_mktsegment, 'nation:' || c_nationkey, c_mktsegment || '/' || c_name || '.bsl' FROM customer)"""
_TEXTS = "texts AS (SELECT source || '/' || lang || '/' || doc_id AS path, text FROM documents)"
_LINES = "lines AS (SELECT path, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS line FROM (SELECT path, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM texts))"
_CODE = """code AS (
  SELECT 'CommonModules/M' || o_custkey || '/Ext/Module.bsl' AS path, 'M' || o_custkey AS module, 'Order' || o_orderkey AS name, o_orderkey AS k, o_orderstatus = 'F' AS is_function, o_orderstatus <> 'P' AS is_export, o_orderpriority AS priority,
    CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 12 AS INTEGER) AS base FROM orders)"""
_SCRIPT = """script AS (
  SELECT *, base + 11 + CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END AS at3, at9_ AS at9, first(k) OVER (ORDER BY k) AS fk, first(cust) OVER (ORDER BY k) AS fcust, first(is_function) OVER (ORDER BY k) AS ff, first(is_export) OVER (ORDER BY k) AS fe FROM (
  SELECT *, base + 11 + CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS at9_ FROM (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY cust ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS base, CAST(sum(size) OVER (PARTITION BY cust) AS INTEGER) AS total, lead(k) OVER (PARTITION BY cust ORDER BY k) AS after FROM (
  SELECT 'CommonModules/M' || o_custkey || '/Ext/Module.bsl' AS path, 'M' || o_custkey AS module, o_custkey AS cust, 'Order' || o_orderkey AS name, o_orderkey AS k, o_orderstatus = 'F' AS is_function, o_orderstatus <> 'P' AS is_export,
    11 + CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 9 IN (4, 5) THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END
    + CASE WHEN o_orderkey % 17 <> 0 THEN 1 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS size FROM orders)))),
said AS (SELECT path, name AS routine, base + 6 AS line, CAST(NULL AS VARCHAR) AS qualifier, 'Внешний' || (k % 11) AS method, 3 AS args, true AS used, false AS nested, k FROM script
  UNION ALL SELECT path, name, base + 6, NULL, name, 2, true, true, k FROM script UNION ALL SELECT path, name, base + 7, NULL, 'Общий', 1, true, true, k FROM script
  UNION ALL SELECT path, name, base + 7, NULL, name, 4, false, false, k FROM script UNION ALL SELECT path, name, base + 10, NULL, 'Сообщить', 1, false, false, k FROM script
  UNION ALL SELECT path, name, base + 11, module, name, 1, true, false, k FROM script
  UNION ALL SELECT path, name, at3 + 1, 'Справочники.C' || (k % 7), 'Найти', 1, false, false, k FROM script WHERE k % 3 = 0
  UNION ALL SELECT path, name, at3 + 1, NULL, 'Метод', 0, NULL, false, k FROM script WHERE k % 3 = 0
  UNION ALL SELECT path, name, at9 + 1, 'M' || fcust, 'Order' || fk, 1, false, false, k FROM script WHERE k % 9 = 4
  UNION ALL SELECT path, name, at9 + 1, 'M' || fcust, 'Нет', 1, false, false, k FROM script WHERE k % 9 = 5
  UNION ALL SELECT path, name, at9 + CASE WHEN k % 9 IN (4, 5) THEN 2 ELSE 1 END, 'Итог', 'Добавить', 1, false, false, k FROM script WHERE k % 4 = 1
  UNION ALL SELECT path, name, at9 + CASE WHEN k % 9 IN (4, 5) THEN 2 ELSE 1 END, 'CommonModule.M' || fcust, 'Order' || fk, 1, false, false, k FROM script WHERE k % 4 = 1)"""
_RIGHTS = """rights AS (
  SELECT source AS role_id, 'doc:' || l.doc_id AS object_id, quality = 1 AS may_read, toxic = 1 AS may_insert, quality = 0 AS has_rls, text AS condition
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_FEATURES = """features AS (
  SELECT id, CASE WHEN length(value) >= 14 THEN 'name' ELSE 'call' END AS category, value
  FROM (SELECT DISTINCT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS value FROM documents) WHERE length(value) >= 9)"""
_PARTS = {"nodes": (_NODES,), "edges": (_EDGES,), "refs": (_EDGES, _REFS), "symbols": (_SYMBOLS,), "objects": (_OBJECTS,), "texts": (_TEXTS,), "lines": (_TEXTS, _LINES), "rights": (_RIGHTS,), "code": (_CODE,), "script": (_SCRIPT,), "features": (_FEATURES,)}


def sql(body: str, *frames: str, more: str = "", recursive: bool = False) -> str:
    """``body`` under the projections it names; ``more`` holds further common table expressions."""
    parts = list(dict.fromkeys(p for f in frames for p in _PARTS[f])) + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body
