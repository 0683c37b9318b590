"""Structure of module code: routines, regions, calls, names, metadata accesses, query tables, from the token scan.

Each question is a filter or one aggregate over the settled frames of a ``Scan``; which routine a line is in is an as-of
join by a sorted window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import COLLECTIONS, QUERY_TABLES, mapped
from ..operators.grep import lines as numbered
from .tokens import HEADER, NAME, QUESTIONS, TYPED, Scan, plain_tokens, routine_rows


def code_lines(texts: DataFrame) -> DataFrame:
    """``path, n, line, code, quoted`` of the lines that a string may touch: the line, its code with strings and comments
    blanked, and what stands in strings."""
    # Other lines have no part in a string; they go before any pattern is tried.
    raw = numbered(texts).where(F.contains("line", F.lit('"')) | F.col("line").rlike(r"^\s*\|"))
    goes_on = F.col("line").rlike(r"^\s*\|")
    whole = F.when(goes_on, F.regexp_replace("line", r'^\s*\|(?:[^"]|"")*+("|$)', "")).otherwise(F.col("line"))
    code = F.regexp_replace(F.regexp_replace(whole, r'"(?:[^"]|"")*+(?:"|$)', '""'), r"//.*$", "")
    quoted = F.when(goes_on, F.regexp_replace("line", r"^\s*\|", "")).otherwise(F.array_join(F.regexp_extract_all(F.regexp_replace("line", r'^([^"]*)//.*$', "$1"), F.lit(r'"((?:[^"]|"")*)("|$)'), F.lit(1)), " "))
    return raw.select("path", "n", "line", code.alias("code"), F.regexp_replace(quoted, "//.*$", "").alias("quoted"))


ROUTINE = ["path", "kind", "name", "is_export", "start_line", "end_line", "parameters", "total", "required", "body_line"]


def routines(texts: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, kind, name, is_export, start_line, end_line, parameters array, total, required, body_line`` of every routine;
    the body begins below the line that closes the parameters."""
    return (scan or Scan(texts)).routines.select(*ROUTINE)


def regions(texts: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, name, depth, start_line, end_line``: an opening at a depth closes at the next end at that depth, or with the
    module; an end without an opening does nothing."""
    t = scan.marked(["path", "n", "total", "text", "kind"], "directive") if scan else plain_tokens(texts)
    word = F.lower(F.regexp_extract("text", rf"^#({NAME})", 1))
    marks = t.where("kind = 'd'").select("path", "n", "total", F.trim(F.regexp_replace("text", rf"^#{NAME}", "")).alias("name"), word.isin("конецобласти", "endregion").alias("ends"), word.alias("word")).where(F.col("word").isin("область", "region", "конецобласти", "endregion"))
    step = F.when(F.col("ends"), -1).otherwise(1)
    w = Window.partitionBy("path").orderBy("n")
    levelled = marks.withColumn("sum", F.sum(step).over(w)).withColumn("floor", F.least(F.min("sum").over(w), F.lit(0)))
    # A stray end lowers the floor; it takes no level.
    stray = F.col("ends") & (F.col("floor") < F.coalesce(F.lag("floor").over(w), F.lit(0)))
    levelled = levelled.withColumn("stray", stray).where("not stray").withColumn("depth", F.col("sum") - F.col("floor") - F.when(F.col("ends"), 0).otherwise(1))
    closing = F.lead(F.when(F.col("ends"), F.col("n"))).over(Window.partitionBy("path", "depth").orderBy("n"))
    return levelled.withColumn("end_line", F.coalesce(closing, F.col("total"))).where("not ends").select("path", "name", F.col("depth").cast("long").alias("depth"), F.col("n").alias("start_line"), "end_line")


def inside(rows: DataFrame, found: DataFrame, first: str = "start_line") -> DataFrame:
    """``rows(path, n, ...)`` with the ``routine`` they stand in, from its line ``first`` on.

    An as-of join: rows and headers of a module are sorted together, and each row takes the last header at or before its
    line, if that routine has not ended. Linear in the rows of a module, whatever the number of its routines.
    """
    names = rows.columns
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names if c != "path"]
    head = F.struct(F.col("name").alias("name"), F.col("end_line").alias("last"))
    starts = found.select("path", *blank, F.col(first).cast("long").alias("_n"), F.lit(0).alias("_kind"), F.struct(F.col("start_line"), head.alias("h")).alias("_head"))
    own = rows.select("path", *[c for c in names if c != "path"], F.col("n").cast("long").alias("_n"), F.lit(1).alias("_kind"), F.lit(None).cast(starts.schema["_head"].dataType).alias("_head"))
    w = Window.partitionBy("path").orderBy("_n", "_kind", "_head.start_line")
    met = starts.unionByName(own).withColumn("_open", F.last("_head", ignorenulls=True).over(w)).where("_kind = 1")
    return met.select(*names, F.when(F.col("_open.h.last") >= F.col("_n"), F.col("_open.h.name")).alias("routine"))


def calls(texts: DataFrame, found: DataFrame, scan: Scan | None = None, nested: bool = True) -> DataFrame:
    """``path, routine, line, callee, qualifier, method``; calls in arguments of calls only if ``nested``."""
    told = (scan or Scan(texts)).calls()
    return (told if nested else told.where("not nested")).select("path", "routine", "line", "callee", "qualifier", "method")


def accesses(texts: DataFrame, found: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, routine, line, target_id, context='code'``: collections of the metadata used in code, also by way of
    ``Метаданные``."""
    x = F.regexp_replace(F.regexp_replace("text", r"\s+", ""), "^Метаданные[.]", "")
    hit = (scan or Scan(texts)).rows("access", QUESTIONS["access"]).select("path", "routine", "n", F.regexp_extract(x, rf"^({NAME})[.]{NAME}", 1).alias("head"), F.regexp_extract(x, rf"^{NAME}[.]({NAME})", 1).alias("object")).where("head <> ''")
    named = hit.withColumn("kind", mapped(COLLECTIONS, F.col("head"), fold=False)).where("kind is not null")
    return named.select("path", "routine", F.col("n").alias("line"), F.concat("kind", F.lit("."), "object").alias("target_id"), F.lit("code").alias("context"))


def query_tables(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``path, routine, line, target_id, context='query'``: tables after ИЗ and СОЕДИНЕНИЕ in strings; virtual tables are
    cut to their first two segments, temporary tables, which have one segment, never match.

    A keyword may end the line before, so the tail of the last non-blank string line is carried over by a window.
    """
    q = code_lines(texts).select("path", "n", F.trim("quoted").alias("q")).where("q <> ''")
    before = F.lag(F.regexp_extract("q", r"(?iu)(?:^|[^\p{L}])(ИЗ|СОЕДИНЕНИЕ)\s*$", 1)).over(Window.partitionBy("path").orderBy("n"))
    text = F.concat_ws(" ", before, "q")
    hit = q.withColumn("t", text).select("path", "n", F.explode(F.regexp_extract_all("t", F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:ИЗ|СОЕДИНЕНИЕ)\s+({NAME}\.{NAME})"), F.lit(1))).alias("x"))
    kind = F.coalesce(mapped(QUERY_TABLES, F.split_part("x", F.lit("."), F.lit(1))), mapped(COLLECTIONS, F.split_part("x", F.lit("."), F.lit(1)), fold=False))
    named = inside(hit.withColumn("kind", kind).where("kind is not null"), found)
    return named.select("path", "routine", F.col("n").alias("line"), F.concat("kind", F.lit("."), F.split_part("x", F.lit("."), F.lit(2))).alias("target_id"), F.lit("query").alias("context"))


def declared(texts: DataFrame, found: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, routine, name, line``: variables that a routine declares or assigns first, and loop variables."""
    hit = (scan or Scan(texts)).assigned().where("routine is not null")
    return hit.groupBy("path", "routine", F.lower("name").alias("key")).agg(F.min(F.struct("at", "line", "name")).alias("f")).select("path", "routine", "f.name", "f.line")


def module_variables(scan: Scan) -> DataFrame:
    """``path, name, line`` of ``Перем`` outside of routines."""
    return scan.assigned().where("routine is null and variable").select("path", "name", "line")


def names_read(texts: DataFrame, found: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, routine, name``: names that a routine reads; what stands left of an assignment is not read."""
    return (scan or Scan(texts)).read().select("path", "routine", "name").distinct()


def call_sites(texts: DataFrame, found: DataFrame, scan: Scan | None = None, nested: bool = False) -> DataFrame:
    """``path, routine, line, qualifier, method, args, used``: calls, those in arguments of others only if ``nested``, how
    many arguments they have (-1: the bracket never closes), and whether their result is used (null: not clear)."""
    told = (scan or Scan(texts)).calls()
    return (told if nested else told.where("not nested")).select("path", "routine", "line", "qualifier", "method", "args", "used")


def functions_without_return(scan: Scan) -> DataFrame:
    """Functions without the word that returns."""
    found = scan.routines if "returns" in scan.routines.columns else routine_rows(scan.marked([*HEADER, "returns"], "header"))
    return found.where("kind = 'Function' and not returns").select(*ROUTINE)


def after_return(scan: Scan) -> DataFrame:
    """``path, routine, line``: what stands behind a statement that returns, where no block ends or branches there."""
    return scan.rows("late", QUESTIONS["late"]).select("path", "routine", F.col("n").alias("line")).distinct()


def visible(points: DataFrame, texts: DataFrame, found: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, line, name``: parameters of the routine around each ``points(path, line)`` and variables declared in it up
    to that line."""
    scan = scan or Scan(texts)
    at = inside(points.select("path", F.col("line").alias("n")).distinct(), found).where("routine is not null")
    parameters = found.select("path", F.col("name").alias("routine"), F.explode("parameters").alias("name"), F.lit(0).alias("from"))
    names = parameters.union(declared(texts, found, scan).select("path", "routine", "name", "line"))
    return at.join(names, ["path", "routine"]).where(F.col("from") <= F.col("n")).select("path", F.col("n").alias("line"), "name").distinct()


def resolve_names(points: DataFrame, scan: Scan) -> DataFrame:
    """``path, line, name, kind, declared`` for each ``points(path, line, name)``: the parameter, local variable, variable of
    the module or routine that a name means at a line, without case, and the line that declares it; null where none does.

    An as-of join in two steps: the routine around the line, then the last declaration of that name in the routine up to
    the line; a declaration that comes later in the routine counts where none comes before.
    """
    # All that is joined is dealt by module once; nothing is moved again for a key within a module.
    deal = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    asked = deal(points.select("path", F.col("line").alias("n"), "name")).distinct()
    at = inside(asked, deal(scan.routines.select("path", "name", "start_line", "end_line"))).withColumn("key", F.lower("name"))
    own = scan.routines.select("path", F.col("name").alias("routine"), F.explode("parameters").alias("p"), F.col("start_line").alias("l")).select("path", "routine", F.lower("p").alias("key"), F.struct(F.lit(0).alias("rank"), F.lit("Parameter").alias("kind"), F.col("l").alias("line")).alias("d"))
    local = scan.assigned().where("routine is not null").select("path", "routine", F.lower("name").alias("key"), F.struct(F.lit(1).alias("rank"), F.lit("Local").alias("kind"), F.col("line")).alias("d"))
    inner = deal(own.union(local)).groupBy("path", "routine", "key").agg(F.min("d").alias("inner"))
    wide = module_variables(scan).select("path", F.lower("name").alias("key"), F.struct(F.lit(2).alias("rank"), F.lit("ModuleVariable").alias("kind"), F.col("line")).alias("d"))
    named = scan.routines.select("path", F.lower("name").alias("key"), F.struct(F.lit(3).alias("rank"), F.lit("Routine").alias("kind"), F.col("start_line").alias("line")).alias("d"))
    outer = deal(wide.union(named)).groupBy("path", "key").agg(F.min("d").alias("outer"))
    met = at.join(inner, ["path", "routine", "key"], "left").join(outer, ["path", "key"], "left").withColumn("d", F.coalesce("inner", "outer"))
    return met.select("path", F.col("n").alias("line"), "name", "d.kind", F.col("d.line").alias("declared"))


def created(scan: Scan) -> DataFrame:
    """``path, routine, name, line, at, block, type`` of every assignment to a name; ``type`` where it creates an object by
    ``Новый T`` or ``Новый("T")`` and nothing else stands in it."""
    targets = scan.rows("assigned", TYPED["assigned"]).where(F.col("target.given") & F.col("routine").isNotNull())
    return targets.select("path", "routine", "target.name", F.col("n").alias("line"), "at", "block", "type")


def inferred_types(texts: DataFrame, found: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, routine, name, line, type`` of ``X = Новый T`` assignments; the last one before a line is its type."""
    return created(scan or Scan(texts)).where("type is not null").select("path", "routine", "name", "line", "type")


def last_types(texts: DataFrame, found: DataFrame, scan: Scan | None = None) -> DataFrame:
    """``path, routine, name, type``: the type by the last assignment; null where that creates no object."""
    hit = created(scan or Scan(texts))
    return hit.groupBy("path", "routine", F.lower("name").alias("key")).agg(F.max(F.struct("at", "name", "type")).alias("l")).select("path", "routine", "l.name", "l.type")
