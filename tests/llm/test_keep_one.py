"""The stage of near copies against all pairs of texts."""

import os
import random
from urllib.parse import urlparse

from codeloom.llm import common, simhash

from . import oracles


def shingles(t, words=5):
    w = oracles.ascii_words(t).split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def plain(docs, threshold=0.8):
    """The ids that stay: the smallest of each component over all pairs."""
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: a == b or len(a & b) >= threshold * len(a | b) - 1e-9 > 0
    g = oracles.groups(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if near(sets[a], sets[b])])
    low = {}
    for (i, _), r in zip(docs, g, strict=True):
        low[r] = min(low.get(r, i), i)
    return sorted(low.values())


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(600)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    license_ = prose(30)
    texts = ["", None, "one two", "One  two", "one two three"]
    for n in (40, 60, 100, 300):
        base = prose(n)
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 4, 6, n // 50, n // 40, n // 30):
            copy = list(base)
            for at in rng.sample(range(n), changes):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
        texts += [" ".join(base[: n * 5 // 6]), " ".join(base + prose(n // 8)), " ".join(license_ + prose(n))]
    # Texts that mostly share one passage, and a chain whose ends are not near.
    texts += [" ".join(license_ + prose(k)) for k in (3, 4, 5, 6, 7, 9)]
    chain = prose(120)
    texts += [" ".join(chain[k : k + 90]) for k in range(0, 31, 6)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == plain(docs)


def test_near_copies_of_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == want


def test_simhash_links_first_and_sets_are_not_kept(spark):
    base = [f"word{i * 7 % 97}x{i}" for i in range(300)]
    docs = [(n, " ".join([*base[:n], "changed", *base[n + 1 :]])) for n in (1, 2, 3)] + [(9, " ".join(reversed(base)))]
    root = urlparse(common.shared_dir(spark)).path
    before = set(os.listdir(root))
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [1, 9]
    made = {x.rpartition("-")[0]: spark.read.parquet(f"{root}/{x}") for x in set(os.listdir(root)) - before}
    assert made["close"].count() > 0
    assert not [name for name, df in made.items() if "h" in df.columns]
