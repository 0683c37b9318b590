"""Paraphrases made by rule, items that stand in many documents, small tables and edges of the benchmark."""

import random

from codeloom.llm import decontam


def world(seed, n_docs=300, n_items=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(3, 8))) for _ in range(3000)]
    weights = [1 / (k + 3) for k in range(len(vocabulary))]
    prose = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(i, " ".join(prose(rng.randint(18, 30))) + ". " + " ".join(prose(8)) + ".") for i in range(n_items)]
    docs = [" ".join(prose(rng.randint(40, 400))) for _ in range(n_docs)]
    return rng, vocabulary, prose, items, docs


def paraphrase(rng, vocabulary, text):
    """A fifth of the words replaced, a tenth inserted, neighbours sometimes swapped; as often as leaves 0.7 in order."""
    words = text.split()
    while True:
        out = []
        for w in words:
            out.append(rng.choice(vocabulary) if rng.random() < 0.2 else w)
            if rng.random() < 0.1:
                out.append(rng.choice(vocabulary))
        for k in range(len(out) - 1):
            if rng.random() < 0.05:
                out[k], out[k + 1] = out[k + 1], out[k]
        plain = [w.strip(".") for w in words]
        if decontam.lcs([w.strip(".") for w in out], decontam.masks(plain), len(plain)) >= 0.7 * len(plain):
            return " ".join(out)


def test_paraphrases(spark):
    rng, vocabulary, prose, items, docs = world(6)
    planted = []
    for n, (i, t) in enumerate(items * 3):
        planted.append((1000 + n, i, " ".join(prose(rng.randint(30, 200))) + " " + paraphrase(rng, vocabulary, t) + " " + " ".join(prose(rng.randint(30, 200)))))
    rows = list(enumerate(docs)) + [(d, t) for d, _, t in planted]
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    recall = sum((d, i) in found for d, i, _ in planted) / len(planted)
    print("recall on paraphrases", recall)
    assert recall >= 0.9
    assert len({d for d, _ in found if d < 1000}) <= 0.01 * len(docs)


def test_item_in_half_of_the_documents_and_small_tables(spark):
    _, _, prose, items, docs = world(9, 60)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(n, t + (" " + items[0][1] if n % 2 else "")) for n, t in enumerate(docs)]
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {(n, 0) for n in range(1, 60, 2)} <= found
    three = spark.createDataFrame([(1, items[3][1]), (2, docs[0]), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(three, bench).collect()} == {(1, 3)}


def test_edges_of_the_benchmark(spark):
    _, _, prose, items, docs = world(12, 20)
    bench = spark.createDataFrame([(None, items[0][1]), (5, None), (6, ""), (7, "..."), (8, items[1][1]), (8, items[1][1]), (9, items[2][1])], "item_id long, text string")
    rows = spark.createDataFrame([(1, items[1][1]), (1, items[1][1]), (2, items[0][1]), (None, items[2][1]), (4, "")], "doc_id long, text string")
    found = decontam.leaks(rows, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 8), (None, 9)}
    assert sum(r.doc_id == 1 for r in found) >= 2
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert decontam.leaks(rows, none).count() == 0
