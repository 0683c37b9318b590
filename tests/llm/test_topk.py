"""Repeated ids, other lengths, and how much the threshold lets through."""

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import topk

SF = "/root/testdata/sf0.01"


def test_repeated_ids_and_other_lengths(spark):
    rows = [(0, [1, 2]), (0, [3, 1]), (1, [1, 1]), (1, [5, 5]), (2, [1, 1]), (3, [9, 9, 9]), (100, [-1, -1]), (200, [7, 7, 7])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), k=3).collect())
    # Query 0 asks once, with [1, 2]; both rows of id 1 are candidates, its own rows are none.
    assert got == [(0, 1, 1, 15), (0, 2, 1, 3), (0, 3, 2, 3), (100, 1, 1, -2), (100, 2, 2, -2), (100, 3, 0, -3), (200, 1, 3, 189)]


def test_threshold_lets_little_through(spark):
    v = topk.quantise(spark.read.parquet(f"{SF}/embeddings.parquet")).orderBy("vec_id").toPandas()
    m = np.array(v["v"].tolist())
    q = m[(v["vec_id"] % 100 == 0).to_numpy()]
    own = np.flatnonzero((v["vec_id"] % 100 == 0).to_numpy())
    parts = [m[:, s] @ q[:, s].T for s in topk._split(m.shape[1], 2)]
    total = sum(parts).T
    total[np.arange(len(q)), own] = np.iinfo(np.int64).min
    a, _ = topk.over_cutoff([p.T for p in parts], np.sort(total, axis=1)[:, -10])
    assert 10 * len(q) <= len(a) < 0.25 * total.size


def test_cutoff_loses_nothing():
    rng = np.random.default_rng(1)
    for nodes in (1, 2, 3):
        parts = [rng.integers(-50, 50, (20, 300)) for _ in range(nodes)]
        bound = np.sort(sum(parts), axis=1)[:, -7]
        a, b = topk.over_cutoff(parts, bound)
        given = set(zip(a.tolist(), b.tolist(), strict=True))
        assert all((i, j) in given for i, j in zip(*np.nonzero(sum(parts) >= bound[:, None]), strict=True))


def test_quantise_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, [0.5]), (1, [0.5]), (2, []), (None, [0.1])], "vec_id long, embedding array<float>")
    assert topk.quantise(df).agg(F.count("*")).first()[0] == 2


def test_copies_of_queries_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, [i, 1]) for i in range(8)], "vec_id long, v array<long>")
    blocks = topk._pack(rows, 4)
    plan = topk._pairs(blocks, blocks, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
