"""Text search over files, with context, owners and routines of the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, n, line``: numbered from 1, any newline style."""
    return texts.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n", -1)).alias("n", "line")).select("path", (F.col("n") + 1).alias("n"), "line")


def file_filter(files: DataFrame, extensions: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    kept = files
    if extensions:
        kept = kept.where(F.lower("path").rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in extensions) + ")$"))
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("path").startswith(p)
        kept = kept.where(hit)
    return kept


def matches(pattern: str, regex: bool = False, ignore_case: bool = True, column: str = "line"):  # noqa: ANN201
    c = F.col(column)
    if regex:
        return c.rlike(("(?i)" if ignore_case else "") + pattern)
    return F.lower(c).contains(pattern.lower()) if ignore_case else c.contains(pattern)


def grep(texts: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = True, context: int = 1, per_file: int = 10, limit: int | None = None) -> DataFrame:
    """Hits ``path, n, line, context``: at most ``per_file`` in a file, module files first, then path and line.

    Texts without a hit go before their lines are made. The lines of a file are an array of its row, so context is a
    slice and no window over lines is shuffled.
    """
    kept = texts.where(matches(pattern, regex, ignore_case, "text")) if not regex else texts
    split = kept.select("path", F.split("text", r"\r\n|\r|\n", -1).alias("all"))
    hit = split.select("path", "all", F.posexplode("all").alias("i", "line")).where(matches(pattern, regex, ignore_case))
    packed = hit.select("path", (F.col("i") + 1).alias("n"), "line", F.array_join(F.slice("all", F.greatest(F.col("i") + 1 - context, F.lit(1)), F.lit(context) + F.least(F.col("i"), F.lit(context)) + 1), "\n").alias("context"))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("n"))
    found = packed.withColumn("nth", nth).where(F.col("nth") <= per_file).drop("nth")
    return found.orderBy(F.desc(F.lower("path").endswith(".bsl")), "path", "n").limit(limit) if limit else found


def fragment(texts: DataFrame, start: int, stop: int, most: int = 400) -> DataFrame:
    """Lines ``start..stop`` of each text, clamped to it and to ``most`` lines: ``path, first, last, total, text``."""
    split = texts.select("path", F.split("text", r"\r\n|\r|\n", -1).alias("all")).withColumn("total", F.size("all"))
    first = F.least(F.greatest(F.lit(start), F.lit(1)), F.col("total"))
    last = F.least(F.when(F.lit(stop) <= 0, F.col("total")).otherwise(F.greatest(F.lit(stop), first)), F.col("total"), first + most - 1)
    told = split.withColumn("first", first).withColumn("last", last)
    return told.select("path", "first", "last", "total", F.array_join(F.slice("all", F.col("first"), F.col("last") - F.col("first") + 1), "\n").alias("text"))


def _wanted(pattern: str) -> list[str]:
    p = pattern.lower()
    return sorted({p[i : i + 3] for i in range(len(p) - 2)})


def trigrams(texts: DataFrame, pattern: str | None = None) -> DataFrame:
    """``gram, path``: the different trigrams of each text, lower-cased; a data-skipping index for ``grep``.

    With a pattern only its trigrams are made, by a test of each on the text: no other gram is ever a row.
    """
    if pattern is not None:
        low = F.lower("text")
        held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in _wanted(pattern)]))
        return texts.select("path", F.explode(held).alias("gram"))
    signs = texts.where(F.length("text") >= 3).select("path", F.lower("text").alias("s"))
    grams = F.transform(F.sequence(F.lit(1), F.length("s") - 2), lambda i: F.substring(F.col("s"), i, F.lit(3)))
    return signs.select("path", F.explode(F.array_distinct(grams)).alias("gram"))


def trigram_candidates(index: DataFrame, pattern: str) -> DataFrame:
    """Paths that hold every trigram of the pattern (three signs or more): a superset of the files with hits."""
    wanted = _wanted(pattern)
    return index.where(F.col("gram").isin(*wanted)).groupBy("path").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("path")


def owner_by_prefix(paths: DataFrame, directories: DataFrame) -> DataFrame:
    """``path, owner``: the owner of the longest directory above each path.

    The prefixes of a path become rows, so the match is an equi-join, not a nested loop over directories.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = paths.select("path", F.explode(up).alias("directory"))
    met = steps.join(directories, "directory").groupBy("path").agg(F.max_by("owner", F.length("directory")).alias("owner"))
    return paths.select("path").join(met, "path", "left")


def routine_at(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """The routine that covers each ``(module_path, line)``, the first by start where several do.

    The module is the join key, so the range condition is checked only within a module.
    """
    s = symbols.select(F.col("module_path").alias("_m"), "start_line", "end_line", F.col("name").alias("routine"))
    met = hits.join(s, (F.col("module_path") == F.col("_m")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left")
    first = F.min(F.struct("start_line", "routine")).alias("r")
    return met.groupBy("module_path", "line").agg(first).select("module_path", "line", "r.routine")


def narrowest_routine(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """The covering routine with the fewest lines."""
    s = symbols.select(F.col("module_path").alias("_m"), "start_line", "end_line", F.col("name").alias("routine"))
    met = hits.join(s, (F.col("module_path") == F.col("_m")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return met.groupBy("module_path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("start_line").alias("s"), F.col("routine").alias("routine"))).alias("r")).select("module_path", "line", "r.routine")


def by_owner(hits: DataFrame, owners: DataFrame) -> DataFrame:
    return hits.join(owners, "path", "left").groupBy("owner").agg(F.count("*").alias("n"))


def comment_heads(numbered: DataFrame, starts: DataFrame, marker: str = "//", most: int = 3) -> DataFrame:
    """Up to ``most`` comment lines right above each ``starts(path, n)``, blank and ``&`` lines skipped."""
    trimmed = F.trim("line")
    # Of other lines than comments only the number moves; lines and starts are dealt once, by path.
    held = numbered.where(~(trimmed.startswith("&") | (trimmed == ""))).select("path", F.col("n").cast("long").alias("n"), F.when(trimmed.startswith(marker), trimmed).alias("line"), F.lit(1).alias("held"), F.lit(0).alias("start"))
    asked = starts.select("path", F.col("n").cast("long").alias("n"), F.lit(None).cast("string").alias("line"), F.lit(0).alias("held"), F.lit(1).alias("start"))
    kept = held.union(asked).repartition("path").groupBy("path", "n").agg(F.max("line").alias("line"), F.max("held").alias("held"), F.sum("start").alias("start")).where("held = 1")
    back = Window.partitionBy("path").orderBy("n")
    above = [F.coalesce(F.lag("line", k).over(back), F.lit("")) for k in range(1, most + 1)]
    seen = kept.select("path", "n", "start", *[a.alias(f"c{k}") for k, a in enumerate(above)]).where("start > 0")
    seen = seen.withColumn("each", F.explode(F.array_repeat(F.lit(0), F.col("start").cast("int"))))
    # A comment counts as long as all below it are comments too.
    goes, lines_ = F.lit(True), []
    for k in range(most):
        goes = goes & F.col(f"c{k}").startswith(marker)
        lines_.insert(0, F.when(goes, F.col(f"c{k}")))
    return seen.select("path", F.col("n").cast(numbered.schema["n"].dataType).alias("n"), F.concat_ws("\n", *lines_).alias("comment_head"))


def decorated(hits: DataFrame, owners: DataFrame, symbols: DataFrame, layers: DataFrame) -> DataFrame:
    """``path, n, line, owner, routine, source_index, overridden`` of hits ``(path, n, line)``: the owner of the file, the
    narrowest routine around the line, the layer that the file comes from and whether it overrides another."""
    from .changes import overlay

    at = narrowest_routine(hits.select(F.col("path").alias("module_path"), F.col("n").alias("line")).distinct(), symbols)
    at = at.select(F.col("module_path").alias("path"), F.col("line").alias("n"), "routine")
    won = overlay(layers).select(F.lower("path").alias("key"), "source_index", "overridden")
    out = hits.withColumn("key", F.lower("path")).join(owners.select("path", "owner"), "path", "left").join(at, ["path", "n"], "left").join(won, "key", "left")
    return out.select("path", "n", "line", "owner", "routine", "source_index", "overridden")
