"""Families of near-equal lines against all earlier lines, with few and with many named candidates."""

import random

import pytest

from codeloom.llm import lines

from . import oracles


def families():
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(150)]
    bases = [rng.choices(vocabulary, k=rng.randint(5, 30)) for _ in range(12)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
            text.append((" " * rng.randint(1, 2)).join(words))
        docs.append((i, rng.choice(["\n", "\n\n"]).join(text) if i % 9 else None))
    return [*docs, (7, docs[7][1]), (7, docs[7][1])]


@pytest.mark.parametrize("most", [1, 4])
def test_families(spark, most):
    docs = families()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lines.dedup_lines(df, named_most=most).collect()
    want = {r[0]: r for r in oracles.lines(docs[:-2])}
    assert len(got) == len(docs)
    for r in got:
        # Rows that repeat id and text are one document.
        assert (r.doc_id, r.n_lines, r.n_removed, oracles.sha(r.text or "")) == want[r.doc_id]
    assert sum(r.n_removed for r in got) > 20
