"""Repeat removal against a count of every string, on texts made to be hard for phrases."""

import random

import numpy as np
import pytest

from codeloom.llm import repeats

from . import oracles


def hard_texts():
    rng = random.Random(11)
    noise = lambda n, of="abcdefghijklmnopqrstuvwxyz ": "".join(rng.choices(of, k=n))
    shared, long = noise(150), noise(3000)
    pieces = [noise(rng.randint(60, 260)) for _ in range(12)]
    mosaics = ["".join(rng.choices(pieces, k=9)) for _ in range(25)]
    return [
        noise(300) + shared + noise(300), noise(250) + shared + noise(40), "a" * 900, "b" * 199, "c" * 200, "d" * 201, long, "x" + long[:2000], long + long[500:900],
        noise(700, "ab\0"), noise(700, "\0\x01"), "\0" * 450, "\0" * 230 + "e" + "\0" * 230, *mosaics, "é" * 140 + noise(30), noise(20) + "é" * 140, *[noise(100) + pieces[0][:40] + shared + pieces[1][:60] + noise(80) for _ in range(12)],
    ]


@pytest.mark.parametrize("hot", [50_000, 1])
def test_hard_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = [(n, t) for n, t in enumerate(hard_texts())] + [(3, "repeated row " * 40), (3, "repeated row " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, oracles.sha(bytes(r.kept))) for r in repeats.remove_repeats(df).collect())
    assert got == sorted(oracles.repeats(docs))


def test_open_phrases_without_a_repeat(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = noise(150)
    df = spark.createDataFrame([(1, noise(400) + shared + noise(400)), (2, noise(400) + shared + noise(400))], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in repeats.remove_repeats(df).collect()] == [(0, 0), (0, 0)]


def test_classes_of_heads_and_parse_suffixes():
    rng = random.Random(2)
    data = ["".join(rng.choices("ab", k=rng.randint(8, 20))).encode() for _ in range(60)]
    before = np.array([rng.randint(0, 6) for _ in data])
    before = np.minimum(before, [len(x) - 3 for x in data])
    phrase, offset = repeats.repeated_starts(data, before, 8)
    want = set()
    for i, x in enumerate(data):
        for o in range(len(x) - 7):
            if before[i] - o >= 0 and any(j != i and 0 <= (p := before[j] - (before[i] - o)) <= len(y) - 8 and y[p : p + 8] == x[o : o + 8] for j, y in enumerate(data)):
                want.add((i, o))
    assert set(zip(phrase.tolist(), offset.tolist(), strict=True)) == want
