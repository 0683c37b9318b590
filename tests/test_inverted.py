"""The stored inverted index against plain search over all texts, and what a lookup reads."""

import math
import random
import re

import pytest

from codeloom.operators import grep, search
from codeloom.sources import inverted


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("абвгдabcdeё1", k=rng.randint(2, 9))) for _ in range(900)]
    texts = {f"M{n:03}/{'Ext' if n % 2 else 'Form'}.bsl": "\n".join(" ".join(rng.choices(vocabulary, k=9)) for _ in range(rng.randint(1, 30))) for n in range(200)}
    texts |= {"empty": "", "null": None, "short": "ab", "needle": "x\nИголка В стоге\nигОЛКА", "emoji": "💀💀💀 иголки"}
    root = str(tmp_path_factory.mktemp("index"))
    inverted.write_inverted(spark.createDataFrame([(p, t, 1) for p, t in texts.items()], "path string, text string, doc_no int").repartition(3), root)
    return inverted.Inverted(spark, root), texts, vocabulary


def test_candidates_hold_every_gram(world):
    index, texts, vocabulary = world
    for pattern in ["иголк", "ИГОЛКА", vocabulary[5] + " " + vocabulary[9], vocabulary[3][:3] or "abc", "💀💀💀", "нет такого"]:
        low = pattern.lower()
        grams = {low[i : i + 3] for i in range(len(low) - 2)}
        want = sorted(p for p, t in texts.items() if t and grams <= {t.lower()[i : i + 3] for i in range(len(t) - 2)})
        if len(low) >= 3:
            got = index.texts().join(index.holding(pattern), "doc_no", "left_semi").select("path").collect()
            assert sorted(r.path for r in got) == want, pattern


@pytest.mark.parametrize(("pattern", "regex"), [("иголк", False), ("аб", False), ("иг[оа]л", True), ("ёёёёёё", False)])
def test_grep_equals_a_scan(spark, world, pattern, regex):
    index, texts, _ = world
    plain = grep.grep(spark.createDataFrame([p for p in texts.items() if p[1] is not None], "path string, text string"), pattern, regex)
    assert sorted(tuple(r) for r in index.grep(pattern, regex).collect()) == sorted(tuple(r) for r in plain.collect())


def test_prefix_search(world):
    index, texts, vocabulary = world
    words = {p: re.findall(r"[^\W_]+", (t or "").lower()) for p, t in texts.items()}
    average = sum(map(len, words.values())) / len(words)
    for query in (f"{vocabulary[1][:2]} {vocabulary[2][:3]}", "ИГОЛ*", "а", "", "nothingatall"):
        asked = inverted.query_words(query)
        tf = [{p: n for p, ws in words.items() if (n := sum(w.startswith(a) for w in ws))} for a in asked]
        want = {}
        for p in set.intersection(*map(set, tf)) if tf else ():
            idf = [max(math.log((len(words) - len(f) + 0.5) / (len(f) + 0.5)), 1e-6) for f in tf]
            want[p] = sum(i * f[p] * 2.2 / (f[p] + 1.2 * (0.25 + 0.75 * len(words[p]) / average)) for i, f in zip(idf, tf, strict=True))
        got = {r.path: r.score for r in index.search(query).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_text_of_a_path(world):
    index, texts, _ = world
    assert [r.text for r in index.text_of("needle").collect()] == [texts["needle"]] and index.text_of("none").count() == 0


def test_a_lookup_reads_a_range(spark, tmp_path):
    """Keys are clustered, so the row groups and files that cannot hold the key are not read."""
    rng = random.Random(6)
    docs = [(f"p{n}", " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300))) for n in range(400)]
    inverted.write_inverted(spark.createDataFrame(docs, "path string, text string"), str(tmp_path / "i"), ("term",))
    index = inverted.Inverted(spark, str(tmp_path / "i"))
    total = index.postings("term").count()
    found = index.postings("term").where("key >= 'qu' and key < 'qv'")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    read = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else None
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key,qu), LessThan(key,qv)]" in found._jdf.queryExecution().toString()
    assert read is None or read < 0.6 * total


def test_first_stage(spark):
    rows = [("1", "Order", "pay bill", None), ("2", "OrderBook", "x", None), ("3", "Bill_Of_Pay", None, None), ("4", "Payment", "the bill", "Total, Bill"), ("5", "Reorder", "", None)]
    symbols = spark.createDataFrame(rows, "node_id string, name string, comment_head string, parameters string")
    ask = lambda q: [(r.node_id, r.stage) for r in search.first_stage_search(symbols, q).collect()]
    assert ask("ORDER") == [("1", 0)] and ask("orderb") == [("2", 1)] and ask("eorde") == [("5", 3)] and ask("zzz") == [] and ask("  ") != [("9", 9)]
    assert {n for n, s in ask("pay bill") if s == 2} == {"1", "3", "4"}


@pytest.mark.parametrize("kind", ["string", "array<string>"])
def test_postings_are_packed_before_they_are_moved(spark, kind):
    docs = [(n * 700, "abcab" + "xyz" * (n % 3)) if kind == "string" else (n * 700, ["a", "b", "a"] + ["c"] * (n % 3)) for n in range(30)]
    packed = inverted.posting_rows(spark.createDataFrame(docs, f"doc_no long, x {kind}").coalesce(1))
    assert "Exchange" not in packed._jdf.queryExecution().toString()
    rows = packed.collect()
    assert len({(r.key, r.block) for r in rows}) == len(rows) and all(r.n == len(r.steps) == len(r.tfs) for r in rows)
    want = [(k, n, 1) for n, x in docs for k in {x[i : i + 3] for i in range(len(x) - 2)}] if kind == "string" else [(k, n, x.count(k)) for n, x in docs for k in set(x)]
    assert sorted(tuple(r) for r in inverted.decoded(packed).collect()) == sorted(want)
