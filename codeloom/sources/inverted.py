"""A stored inverted index of texts: postings of terms and trigrams, clustered by key, with delta-coded lists.

A posting row holds the documents of one key within one block of documents, so a frequent key is many rows of bounded size.
Rows are sorted by key over range partitions: a lookup of a key or of a prefix is a range of the sort order, which row-group
statistics turn into a read of a few row groups.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grep as grep_
from ..plans.settle import settle

TERM = r"[\p{L}\p{N}]+"
#: Documents of a block, as a power of two.
BLOCK = 12
#: Postings of a block that a task holds before it gives them; a key of more has several rows in the block.
HELD = 1 << 21
#: Signs that part the words of a query.
PARTS = " ./\\(),:#*\"'"
#: Above every sign that a key may have.
LAST = "\U0010ffff"
K1, B = 1.2, 0.75


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(TERM), F.lit(0))


def posting_rows(source: DataFrame) -> DataFrame:
    """``key, block, n, first, steps, tfs`` of ``source(doc_no, x)`` in the stored order: the words ``x`` with their counts, or
    the different trigrams of the text ``x``.

    Documents of a block follow each other in the stored files, so a task packs the lists of a block itself: what is
    shuffled later is a row for each key and block, not one for each key and document.
    """
    words = source.schema["x"].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tfs, block, held = defaultdict(list), defaultdict(list), -1, 0
        for part in (batch.slice(a, 256) for batch in batches for a in range(0, len(batch), 256)):
            for no, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if held and (no >> BLOCK != block or held >= HELD):
                    yield _packed(docs, tfs, block)
                    docs, tfs, held = defaultdict(list), defaultdict(list), 0
                block = no >> BLOCK
                if words:
                    found = Counter(x)
                    for key, tf in found.items():
                        docs[key].append(no)
                        tfs[key].append(tf)
                else:
                    found = {x[i : i + 3] for i in range(len(x) - 2)}
                    for key in found:
                        docs[key].append(no)
                held += len(found)
        if held:
            yield _packed(docs, tfs, block)

    return source.select("doc_no", "x").mapInArrow(run, "key string, block long, n int, first long, steps array<int>, tfs array<int>")


def _packed(docs: dict[str, list[int]], tfs: dict[str, list[int]], block: int) -> pa.RecordBatch:
    n = np.fromiter(map(len, docs.values()), np.int32, len(docs))
    ends = np.cumsum(n)
    ids = np.fromiter(chain.from_iterable(docs.values()), np.int64, int(ends[-1]))
    steps = np.diff(ids, prepend=ids[:1])
    steps[ends - n] = 0
    counts = np.fromiter(chain.from_iterable(tfs.values()), np.int32, len(ids)) if tfs else np.ones(len(ids), np.int32)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (steps, counts)]
    return pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(np.full(len(n), block, np.int64)), pa.array(n), pa.array(ids[ends - n]), *lists], ["key", "block", "n", "first", "steps", "tfs"])


def write_inverted(texts: DataFrame, root: str, kinds: tuple[str, ...] = ("term", "gram")) -> None:
    """Store ``texts(path, text)`` sorted by path, and the postings of the chosen kinds.

    The number of a document is its place in the stored order. Null texts are stored and have no postings.
    """
    spark, root = texts.sparkSession, root.rstrip("/")
    ordered = texts.select("path", "text").repartitionByRange("path").sortWithinPartitions("path").withColumn("doc_no", F.monotonically_increasing_id())
    ordered.withColumn("n_terms", F.coalesce(F.size(words_of("text")), F.lit(0))).write.parquet(f"{root}/texts")
    stored = spark.read.parquet(f"{root}/texts").where("text is not null")
    made = {"term": words_of("text"), "gram": F.lower("text")}
    for kind in kinds:
        # Settled, as the bounds of the ranges are drawn from the rows before these are moved.
        coded = settle(posting_rows(stored.select("doc_no", made[kind].alias("x"))))
        coded.repartitionByRange("key", "block").sortWithinPartitions("key", "block").write.option("parquet.block.size", 1 << 20).parquet(f"{root}/{kind}")


def decoded(postings: DataFrame) -> DataFrame:
    """``(key, doc_no, tf)`` of posting rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.int64)
            steps = batch.column(3).flatten().to_numpy().astype(np.int64)
            begin = np.cumsum(n) - n
            total = np.cumsum(steps)
            ids = np.repeat(batch.column(2).to_numpy() - total[begin], n) + total if len(n) else total
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), batch.column(4).flatten()], ["key", "doc_no", "tf"])

    return postings.select("key", "n", "first", "steps", "tfs").mapInArrow(run, "key string, doc_no long, tf int")


class Inverted:
    """A stored index below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/texts")

    def postings(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}")

    def text_of(self, path: str) -> DataFrame:
        """``path, text`` of one file: a key of the stored order."""
        return self.texts().where(F.col("path") == path).select("path", "text")

    def holding(self, pattern: str) -> DataFrame:
        """``doc_no`` of the texts that hold every trigram of a pattern of three signs or more, case folded.

        Counts of the pattern's grams come first; then only blocks in which the rarest one stands are decoded.
        """
        low = pattern.lower()
        wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        found = self.postings("gram").where(F.col("key").isin(wanted))
        sizes = {r["key"]: r["n"] for r in found.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # one row a gram of the pattern
        if len(sizes) < len(wanted):
            return self.texts().where(F.lit(False)).select("doc_no")
        rarest = min(wanted, key=lambda g: (sizes[g], g))
        blocks = found.where(F.col("key") == rarest).select("block")
        met = decoded(found.join(blocks, "block", "left_semi")).groupBy("doc_no").agg(F.count("*").alias("n"))
        return met.where(F.col("n") == len(wanted)).select("doc_no")

    def grep(self, pattern: str, regex: bool = False, ignore_case: bool = True, context: int = 1, per_file: int = 10, limit: int | None = None) -> DataFrame:
        """``grep`` over the stored texts: candidates by the index where the pattern allows it, else over all of them."""
        texts = self.texts()
        if not regex and len(pattern) >= 3:
            texts = texts.join(self.holding(pattern), "doc_no", "left_semi")
        return grep_.grep(texts.select("path", "text"), pattern, regex, ignore_case, context, per_file, limit)

    def search(self, query: str) -> DataFrame:
        """``path, score`` of the texts that hold, for every word of the query, a term that begins with it.

        A word is a range of the stored keys and counts as one term: its frequency in a text is that of all terms with the
        prefix. Scores are BM25; a word in more than half of the texts weighs next to nothing, but must be there.
        """
        words = query_words(query)
        if not words:
            return self.texts().where(F.lit(False)).select("path", F.lit(0.0).alias("score"))
        hits = None
        for i, w in enumerate(words):
            ranged = self.postings("term").where((F.col("key") >= w) & (F.col("key") < w + LAST))
            one = decoded(ranged).groupBy("doc_no").agg(F.sum("tf").alias("tf")).withColumn("word", F.lit(i))
            hits = one if hits is None else hits.unionByName(one)
        docs = self.texts().select("doc_no", "path", F.col("n_terms").alias("dl"))
        return prefix_scores(hits, docs, len(words))


def query_words(query: str) -> list[str]:
    low = query.lower()
    for sign in PARTS:
        low = low.replace(sign, " ")
    return list(dict.fromkeys(low.split()))


def prefix_scores(hits: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``path, score`` by ``hits(doc_no, word, tf)`` and ``docs(doc_no, path, dl)``: documents with all ``words`` words."""
    whole = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    full = hits.groupBy("doc_no").agg(F.count("*").alias("k"), F.collect_list(F.struct("word", "tf")).alias("h")).where(F.col("k") == words)
    rows = full.select("doc_no", F.inline("h")).join(F.broadcast(df), "word").crossJoin(F.broadcast(whole)).join(docs, "doc_no")  # a row a word; one row
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("path").agg(F.sum(part).alias("score"))
