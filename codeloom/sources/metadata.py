"""Metadata, forms and rights from XML, with ``from_xml`` against fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import SECTIONS, reference

_SYNONYM = "Synonym STRUCT<item: ARRAY<STRUCT<lang: STRING, content: STRING>>>"
_TYPE = "Type STRUCT<Type: ARRAY<STRING>>"
_CHILD = f"STRUCT<_uuid: STRING, Properties: STRUCT<Name: STRING, {_SYNONYM}, Comment: STRING, {_TYPE}>>"
_ITEMS = ", ".join(f"{k}: ARRAY<{_CHILD}>" for k in ("Attribute", "TabularSection", "Dimension", "Resource", "EnumValue", "Command", "Parameter"))
OBJECT = f"Object STRUCT<_uuid: STRING, Properties: STRUCT<Name: STRING, {_SYNONYM}, Comment: STRING, Content: STRUCT<Item: ARRAY<STRING>>, Source: STRUCT<Type: ARRAY<STRING>>, Event: STRING, Handler: STRING, MethodName: STRING>, ChildObjects: STRUCT<{_ITEMS}, Form: ARRAY<STRING>, Template: ARRAY<STRING>>>"
OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}


def _c(x):  # noqa: ANN001, ANN202
    return F.col(x) if isinstance(x, str) else x


def synonym(properties):  # noqa: ANN001, ANN201
    """The Russian synonym, else the first."""
    items = properties["Synonym"]["item"]
    return F.coalesce(F.get(F.filter(items, lambda i: i["lang"] == "ru"), F.lit(0))["content"], F.get(items, F.lit(0))["content"])


def _parsed(texts: DataFrame) -> DataFrame:
    """``path, kind, o``: the object of every metadata file; its element is renamed so that one schema fits all kinds."""
    kind = F.regexp_extract("text", r"<MetaDataObject[^>]*>\s*<([A-Za-z]+)", 1)
    found = texts.where(F.lower("path").endswith(".xml") & F.contains("text", F.lit("<MetaDataObject"))).withColumn("kind", kind).where("kind <> ''")
    renamed = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(<MetaDataObject[^>]*>\s*)<[A-Za-z]+", "$1<Object"), r"</[A-Za-z]+>(\s*</MetaDataObject>)", "</Object>$1"), r"^\s*(<\?xml[^>]*\?>)?\s*", "")
    return found.select("path", "kind", F.from_xml(renamed, OBJECT, OPTIONS)["Object"].alias("o"))


def objects(texts: DataFrame) -> DataFrame:
    """Top-level objects and their named children: ``id, kind, name, synonym, uuid, comment, parent_id, source_path, types``."""
    p = _parsed(texts)
    top_id = F.when(F.col("kind") == "Configuration", F.lit("Configuration")).otherwise(F.concat("kind", F.lit("."), "o.Properties.Name"))
    none = F.expr("cast(null as array<string>)")
    top = p.select(top_id.alias("id"), "kind", F.col("o.Properties.Name").alias("name"), synonym(F.col("o.Properties")).alias("synonym"), F.col("o._uuid").alias("uuid"), F.col("o.Properties.Comment").alias("comment"), F.lit(None).cast("string").alias("parent_id"), F.col("path").alias("source_path"), none.alias("types"))
    out = top
    for k in ("Attribute", "TabularSection", "Dimension", "Resource", "EnumValue", "Command", "Parameter"):
        c = p.select(top_id.alias("parent_id"), "path", F.explode(F.col(f"o.ChildObjects.{k}")).alias("c"))
        out = out.unionByName(c.select(F.concat("parent_id", F.lit(f"/{k}."), "c.Properties.Name").alias("id"), F.lit(k).alias("kind"), F.col("c.Properties.Name").alias("name"), synonym(F.col("c.Properties")).alias("synonym"), F.col("c._uuid").alias("uuid"), F.col("c.Properties.Comment").alias("comment"), "parent_id", F.col("path").alias("source_path"), F.col("c.Properties.Type.Type").alias("types")))
    for k in ("Form", "Template"):  # named only; their own files hold the rest
        c = p.select(top_id.alias("parent_id"), F.explode(F.col(f"o.ChildObjects.{k}")).alias("name"))
        out = out.unionByName(c.select(F.concat("parent_id", F.lit(f"/{k}."), "name").alias("id"), F.lit(k).alias("kind"), "name", "parent_id"), allowMissingColumns=True)
    return out


def references(texts: DataFrame) -> DataFrame:
    """``source_id, target_id, context, detail``: types of attributes, content of subsystems, sources of events."""
    items = objects(texts).where("types is not null").select(F.coalesce("parent_id", "id").alias("source_id"), F.col("name").alias("detail"), F.explode("types").alias("t"))
    typed = items.withColumn("r", reference("t")).where("r is not null").select("source_id", F.concat("r.kind", F.lit("."), "r.name").alias("target_id"), F.lit("type").alias("context"), "detail")
    p = _parsed(texts).select(F.concat("kind", F.lit("."), "o.Properties.Name").alias("source_id"), F.col("o.Properties").alias("p"))
    content = p.select("source_id", F.explode("p.Content.Item").alias("target_id"), F.lit("content").alias("context"), F.lit(None).cast("string").alias("detail"))
    event = p.select("source_id", F.explode("p.Source.Type").alias("t"), F.col("p.Event").alias("detail")).withColumn("r", reference("t")).where("r is not null")
    return typed.union(content).union(event.select("source_id", F.concat("r.kind", F.lit("."), "r.name"), F.lit("event"), "detail"))


def entry_facts(texts: DataFrame) -> DataFrame:
    """Subscriptions and scheduled jobs with the handler they name: ``kind, id, object_id, event, module_path, procedure``."""
    p = _parsed(texts).where("kind in ('EventSubscription', 'ScheduledJob')")
    handler = F.coalesce("o.Properties.Handler", "o.Properties.MethodName")
    source = F.get(F.col("o.Properties.Source.Type"), F.lit(0))
    r = reference(source)
    return p.select(
        F.when(F.col("kind") == "ScheduledJob", "Job").otherwise("Subscription").alias("kind"), F.concat("kind", F.lit("."), "o.Properties.Name").alias("id"), F.concat(r["kind"], F.lit("."), r["name"]).alias("object_id"), F.col("o.Properties.Event").alias("event"),
        F.concat(F.lit("CommonModules/"), F.split_part(handler, F.lit("."), F.lit(-2)), F.lit("/Ext/Module.bsl")).alias("module_path"), F.split_part(handler, F.lit("."), F.lit(-1)).alias("procedure"),
    )


def form_items(texts: DataFrame) -> DataFrame:
    """``form_path, kind, name, detail`` of attributes, commands, elements with a data path, and handlers.

    Elements nest to any depth, so elements and handlers come from XPath over the whole file.
    """
    forms = texts.where(F.lower("path").endswith("/ext/form.xml"))

    def rows(kind: str, names: str, details: str):  # noqa: ANN202
        both = F.arrays_zip(F.xpath("text", F.lit(names)).alias("a"), F.xpath("text", F.lit(details)).alias("b"))
        return forms.select(F.col("path").alias("form_path"), F.lit(kind).alias("kind"), F.explode(both).alias("z")).select("form_path", "kind", F.col("z.a").alias("name"), F.col("z.b").alias("detail"))

    out = rows("Attribute", "/Form/Attributes/Attribute/@name", "/Form/Attributes/Attribute/@id")
    out = out.union(rows("Command", "/Form/Commands/Command/@name", "/Form/Commands/Command/Action/text()"))
    out = out.union(rows("Element", "//ChildItems//DataPath/../@name", "//ChildItems//DataPath/text()"))
    return out.union(rows("Handler", "//Events/Event/@name", "//Events/Event/text()"))


def link_handlers(items: DataFrame, routines: DataFrame) -> DataFrame:
    """Handlers and commands with the routine of the form's module of that exact name: ``is_resolved, start_line``."""
    wanted = items.where("kind in ('Handler', 'Command') and detail is not null").withColumn("module_path", F.regexp_replace("form_path", r"\.xml$", "/Module.bsl"))
    known = routines.select(F.col("path").alias("module_path"), F.col("name").alias("detail"), "start_line")
    return wanted.join(known, ["module_path", "detail"], "left").withColumn("is_resolved", F.col("start_line").isNotNull())


def data_path_attribute(items: DataFrame) -> DataFrame:
    """Elements with the attribute that the head of their data path names, without case."""
    e = items.where("kind = 'Element'").withColumn("key", F.lower(F.split_part("detail", F.lit("."), F.lit(1))))
    a = items.where("kind = 'Attribute'").select("form_path", F.lower("name").alias("key"), F.col("name").alias("attribute"))
    return e.join(a, ["form_path", "key"], "left").drop("key")


RIGHTS = "object ARRAY<STRUCT<name: STRING, right: ARRAY<STRUCT<name: STRING, value: BOOLEAN, restrictionByCondition: ARRAY<STRUCT<condition: STRING>>>>>>"


def rights(texts: DataFrame) -> DataFrame:
    """``role_id, object_id, rights map<string,boolean>, has_rls, condition`` (the first condition) of every rights file."""
    files = texts.where(F.lower("path").endswith("/rights.xml"))
    o = files.select(F.concat(F.lit("Role."), F.split_part("path", F.lit("/"), F.lit(2))).alias("role_id"), F.explode(F.from_xml(F.regexp_replace("text", r"^\s*(<\?xml[^>]*\?>)?\s*", ""), RIGHTS, OPTIONS)["object"]).alias("o"))
    conditions = F.filter(F.flatten(F.transform("o.right", lambda r: F.coalesce(r["restrictionByCondition"]["condition"], F.expr("cast(array() as array<string>)")))), lambda c: c.isNotNull() & (F.trim(c) != ""))
    target = F.concat(F.split_part("o.name", F.lit("."), F.lit(1)), F.lit("."), F.split_part("o.name", F.lit("."), F.lit(2)), nested_tail(F.col("o.name")))
    known = F.split_part("o.name", F.lit("."), F.lit(1)).isin(*sorted(set(SECTIONS.values())))
    named = F.when(F.col("o.name").startswith("Configuration"), F.lit("Configuration")).when(known, target)
    return o.select("role_id", named.alias("object_id"), F.map_from_entries(F.transform("o.right", lambda r: F.struct(r["name"], r["value"]))).alias("rights"), (F.size(conditions) > 0).alias("has_rls"), F.get(conditions, F.lit(0)).alias("condition")).where("object_id is not null")


def nested_tail(name):  # noqa: ANN001, ANN201
    """``/B.Y/C.Z`` of ``A.X.B.Y.C.Z``."""
    return F.regexp_replace(F.regexp_replace(name, r"^[^.]*\.[^.]*", ""), r"\.([^.]+)\.([^.]+)", "/$1.$2")
