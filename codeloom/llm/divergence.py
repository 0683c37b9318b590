"""Audit of how the sources of a language diverge: term distributions of all (language, source) groups, compared exactly.

The distance of two groups is a sum over the whole vocabulary of their language, but most terms are missing from most
groups. It is taken by inclusion and exclusion over the supports: histograms of the counts of each group price the terms as
if the other group had none of them, a join of the postings corrects the terms that both have, and a constant covers the
terms that neither has. No group is ever expanded to the whole vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of a term (letters and every byte of a sign beyond ASCII); A-Z to a-z, all others to a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Entries that a task holds before it hands its counts on, and bytes of a text that are split at once.
HELD = 200_000
STRETCH = 1 << 22
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in stretches that end between two terms."""
    raw = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= STRETCH else raw.find(b" ", at + STRETCH)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for a in range(0, len(terms), 20_000):
                some = terms[a : a + 20_000]
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in terms_of(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from given()
                size = 0
    yield from given()


def share(n: str | Column, whole: str | Column, scale: int) -> Column:
    """``1 + floor(scale * (n + 1) / whole)`` in decimals, as counts of a large corpus times the scale pass 64 bits."""
    n, whole = (F.col(x) if isinstance(x, str) else x for x in (n, whole))
    top = (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(12,0)")
    return F.lit(1) + F.call_function("div", top, whole.cast("decimal(19,0)"))


def gap(p: str | Column, q: str | Column) -> Column:
    """``floor((p - q) ** 2 / q)``. Shares are at most ``scale + 1``, so the square fits 64 bits for a scale of 10 ** 9,
    and so does any sum of gaps over a vocabulary of under 10 ** 9 terms: shares of a group add up to ``scale`` plus one a term."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``(lang, source, term, n, total, first)``: occurrences of each kept term in each group that has it, and in the whole
    language; ``first`` is 1 on one row of each (lang, term). A term is kept by a language with ``least_docs`` documents
    that have it. Tasks add up their own counts before the shuffle, so a hot source or word is one row a task."""
    text = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = text.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    told = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"), F.min("source").over(of_term).alias("least"))
    return told.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("source") == F.col("least")).cast("long").alias("first"))


def audit(docs: DataFrame, least_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) group of ``docs(lang, source, text)``.

    Part ``pair``: each other source of the language by its distance, all of them. Part ``term``: the ``top`` terms whose
    share in the group passes their share in the language by most. Nulls count as ''; terms are runs of ASCII letters and
    signs beyond ASCII, A-Z lower-cased. Ties of a rank go by item. A group without a kept term has its pairs and no terms;
    a language that keeps no term has pairs of value 0. Repeated rows count as often as they stand there, texts are read
    whole, other columns are ignored, and an empty table gives no rows. Pairs of sources that share a term meet in a join
    on the term: as many rows as the result has pairs, for each term at most.
    """
    post = cut(postings(docs, least_docs), "postings")
    sums = post.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("*").alias("support"), F.sum("first").alias("own"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = every.join(sums, ["lang", "source"], "left").na.fill(0, ["n_all", "support", "own"])
    langs = groups.groupBy("lang").agg(F.sum("own").alias("v"), F.sum("n_all").alias("lang_all"))
    whole = F.greatest(F.col("n_all") + F.col("v"), F.lit(1))
    groups = groups.join(langs, "lang").withColumn("zero", share(F.lit(0), whole, scale))
    groups = cut(groups.select("lang", "source", "n_all", "support", "v", "lang_all", "zero"), "groups")

    priced = post.join(groups, ["lang", "source"]).withColumn("p", share("n", F.col("n_all") + F.col("v"), scale))
    terms = priced.withColumn("q", share("total", F.col("lang_all") + F.col("v"), scale)).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))

    def side(of: DataFrame, s: str, *columns: str) -> DataFrame:
        return of.select("lang", F.col("source").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])

    pairs = side(groups, "a", "support", "v", "zero").join(side(groups, "b", "support", "zero"), "lang").where("a <> b")
    neither = (F.col("v_a") - F.col("support_a") - F.col("support_b")) * gap("zero_a", "zero_b")
    neither = pairs.select("lang", "a", "b", F.when(F.col("v_a") > 0, neither).otherwise(0).alias("value"))
    hist = priced.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("k"))
    met = side(hist, "a", "p", "k", "zero").join(side(groups, "b", "zero"), "lang").where("a <> b")
    # A histogram meets the others twice: as the group whose distance is taken, and as the group it is taken to.
    met = met.groupBy("lang", "a", "b").agg(F.sum(F.col("k_a") * gap("p_a", "zero_b")).alias("to"), F.sum(F.col("k_a") * gap("zero_b", "p_a")).alias("back"))
    met = met.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(v).alias("value")) for x, y, v in (("a", "b", "to"), ("b", "a", "back"))])))
    sparse = priced.select("lang", "term", "source", "p", "zero")
    left = sparse.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("zero_a"))
    right = sparse.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))

    def more(x: str, y: str) -> Column:
        return F.sum(gap(f"p_{x}", f"p_{y}") - gap(f"p_{x}", f"zero_{y}") - gap(f"zero_{x}", f"p_{y}") + gap(f"zero_{x}", f"zero_{y}"))

    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(more("a", "b").alias("to"), more("b", "a").alias("back"))
    both = both.select("lang", F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(v).alias("value")) for x, y, v in (("a", "b", "to"), ("b", "a", "back"))])))
    pairs = neither.unionByName(met).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
