"""Exact top-k inner products by a three-phase uniform threshold.

The components are dealt into ``nodes`` ranges; a node knows only its part of every vector, so a score is a sum of one
partial score per node. (1) Each node gives its best local scores; the k-th best total of the vectors it names is a
bound that the true k-th best reaches. (2) A total that reaches the bound must reach bound / nodes at one node at
least: that safe cutoff goes out, and each node gives every entry above it. (3) Entries whose upper bound still
reaches the k-th best are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_ROWS, BLOCK_QUERIES = 4096, 512


def quantise(vectors: DataFrame, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id long, v array<long>)`` with floor(scale * x) of every component as double.

    Rows whose id or vector is null, empty, or holds a null or non-finite component take no part. Repeated rows stay.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & fine & (F.size(vector) > 0))
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _pack(rows: DataFrame, size: int, extra: str = "") -> DataFrame:
    """Rows of ``(vec_id, v[, bound])`` in blocks, in any order: ids and matrix as binary, ``no`` counted within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            widths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(widths):  # vectors of another length than the query's score nothing
                rows = batch.filter(pa.array(widths == width))
                for a in range(0, len(rows), size):
                    some = rows.slice(a, size)
                    cells = {"no": [part * 100_003 + seq], "width": [int(width)], "ids": [some.column(0).to_numpy().tobytes()], "m": [some.column(1).flatten().to_numpy().tobytes()]}
                    if extra:
                        cells |= {"bound": [some.column(2).to_numpy().tobytes()]}
                    yield pa.RecordBatch.from_pydict(cells)
                    seq += 1

    return rows.mapInArrow(run, f"no long, width long, ids binary, m binary{extra}")


def _product(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer scores; through double precision where no partial sum can leave its exact range."""
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1]
    return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64) if most < 2**53 else c @ q.T


def _pairs(blocks: DataFrame, queries: DataFrame, groups: int) -> DataFrame:
    """Every candidate block beside every block of the stated queries: query blocks are copied to each group.

    The copies are shuffled: an estimate of their size leaves out how often they are copied, and a broadcast by it would
    gather all copies in the driver.
    """
    left = blocks.withColumn("g", F.pmod(F.xxhash64("no"), F.lit(groups).cast("long")))
    names = {c: f"q_{c}" for c in queries.columns if c != "width"}
    right = queries.withColumnsRenamed(names).withColumn("g", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    return left.join(right.hint("merge"), ["g", "width"])


def _split(width: int, nodes: int) -> list[slice]:
    edge = [width * i // nodes for i in range(nodes + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:], strict=False)]


#: The bound of a query that has fewer than k candidates.
NO_BOUND = -(1 << 62)


def over_cutoff(parts: list[np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which (query, candidate) entries the nodes give: those that reach ``bound / nodes`` at one node at least and whose
    known parts, with less than the cutoff for each part held back, may reach the bound of their query."""
    cutoff = -(-bound // len(parts))
    known = [p >= cutoff[:, None] for p in parts]
    most = sum(np.where(k, p, cutoff[:, None] - 1) for k, p in zip(known, parts, strict=True))
    return np.nonzero(np.logical_or.reduce(known) & (most >= bound[:, None]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, nodes: int = 2) -> DataFrame:
    """The ``k`` highest inner products of each query with every vector but its own, ties to the smaller id.

    ``vectors`` and ``queries`` hold ``(vec_id long, v array<long>)``, as ``quantise`` gives them. Returns
    ``query_id, rank int, vec_id, score long``; a query with fewer candidates returns all. Each row of ``vectors`` is a
    candidate, so an id that repeats may be listed once per row; rows of the query's own id are none. A query id that
    repeats is asked once, with its smallest vector. Vectors of another length than the query's are no candidates.
    Empty inputs give no rows. Memory of a task is one pair of blocks.
    """
    vectors, queries = cut(vectors, "vectors"), cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    groups = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = _pack(vectors.repartition(groups), BLOCK_ROWS)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, m, q_ids, q_m in zip(*(batch.column(c).to_pylist() for c in ("width", "ids", "m", "q_ids", "q_m")), strict=True):
                c_ids, q = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                cs, qs = np.frombuffer(m, np.int64).reshape(-1, width), np.frombuffer(q_m, np.int64).reshape(-1, width)
                for node, s in enumerate(_split(width, nodes)):
                    scores = np.where(c_ids[None, :] == q[:, None], np.iinfo(np.int64).min, _product(cs[:, s], qs[:, s]).T)
                    n = min(k, len(c_ids))
                    top = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < len(c_ids) else np.tile(np.arange(n), (len(q), 1))
                    best = np.take_along_axis(scores, top, 1)
                    real = (best > np.iinfo(np.int64).min).ravel()
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q, n)[real], "node": pa.array(np.full(int(real.sum()), node), pa.int32()), "vec_id": c_ids[top].ravel()[real], "part": best.ravel()[real]})

    score = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def ranked(pairs: DataFrame) -> DataFrame:
        """Exact scores of ``(query_id, vec_id)`` pairs from the whole vectors, ranked in each query."""
        scored = pairs.join(vectors, "vec_id").join(asked, "query_id").where(F.size("v") == F.size("q")).select("query_id", "vec_id", score.alias("score"))
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    # Phase 1: the best local scores of each node; the k-th best total of what they name.
    found = _pairs(blocks, _pack(queries, BLOCK_QUERIES), groups).mapInArrow(lists, "query_id long, node int, vec_id long, part long")
    best = Window.partitionBy("query_id", "node").orderBy(F.desc("part"), "vec_id")
    named = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "vec_id").distinct()
    bounds = cut(ranked(named).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound")), "bounds")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, ids, m, q_ids, q_m, q_bound in zip(*(batch.column(c).to_pylist() for c in ("width", "ids", "m", "q_ids", "q_m", "q_bound")), strict=True):
                c_ids, q, bound = (np.frombuffer(x, np.int64) for x in (ids, q_ids, q_bound))
                cs, qs = np.frombuffer(m, np.int64).reshape(-1, width), np.frombuffer(q_m, np.int64).reshape(-1, width)
                a, b = over_cutoff([_product(cs[:, s], qs[:, s]).T for s in _split(width, nodes)], bound)
                other = c_ids[b] != q[a]
                yield pa.RecordBatch.from_pydict({"query_id": q[a[other]], "vec_id": c_ids[b[other]]})

    # Phase 2: the bound travels with the query blocks; nodes give all entries that may reach it.
    told = _pack(queries.join(bounds, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(NO_BOUND)).alias("bound")), BLOCK_QUERIES, ", bound binary")
    enough = cut(_pairs(blocks, told, groups).mapInArrow(entries, "query_id long, vec_id long").distinct(), "entries")

    # Phase 3: these are scored from the whole vectors.
    return ranked(enough).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
