"""Toxicity: held-out accuracy on the test tables, planted texts, features by hand, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    return docs, labels, toxicity.fit(docs.where(learn), labels.where(learn))


def test_held_out(trained):
    docs, labels, model = trained
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).join(labels, "doc_id")
    rows = toxicity.predict(held, model, keep=["doc_id", "toxic"]).collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert len(toxic) > 100 and len(clean) > 1000
    assert sum(s >= 0.7 for s in toxic) / len(toxic) > 0.88
    assert sum(s >= 0.7 for s in clean) / len(clean) < 0.005
    # Calibrated: of the texts with a score near a half or more, about as many are toxic as the scores say.
    sure = [r for r in rows if r.score > 0.3]
    assert abs(sum(r.score for r in sure) - sum(r.toxic for r in sure)) < 0.1 * len(sure)


def test_planted_texts(spark, trained):
    docs, _, model = trained
    clean = [r.text for r in docs.where("lang = 'en' and n_chars between 300 and 3000").orderBy("doc_id").limit(400).collect()]
    before = [r.score for r in toxicity.predict(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    plain = [t for t, s in zip(clean, before, strict=True) if s < 0.1][:100]
    insults = ["idiot", "moron", "scum", "loser"]

    def with_(words, n=4):
        out = []
        for i, t in enumerate(plain):
            w = t.split(" ")
            for k in range(n):
                w.insert((i * 7 + k * 11) % len(w), words[(i + k) % len(words)])
            out.append(" ".join(w))
        return out

    sets = {"plain": insults, "masked": ["id1ot", "m0r0n", "s.c.u.m", "l-o-s-e-r"], "drawn": ["idiiiiot", "morooooon", "scummmm", "looooser"], "loud": ["IDIOT!!", "MORON###", "SCUM", "LOSER"]}
    for name, words in sets.items():
        scores = toxicity.predict(spark.createDataFrame(list(enumerate(with_(words))), "doc_id long, text string"), model).collect()
        assert sum(r.score >= 0.7 for r in scores) > 0.7 * len(plain), name


def test_sums_by_hand():
    words = toxicity.CodeWords(["scum"], "alpha")
    none = toxicity.Lexicon(words.hashes(), np.full((1, toxicity.FOLDS + 1), 4, np.float32))
    parts = ["You SCUM!! s-c-u-m then s c u m 12", "", "aaa scuuum é? scum", "   "]
    sums, most = toxicity.measured(parts, none, np.full(4, toxicity.FOLDS))
    x = {k: v.tolist() for k, v in zip(toxicity.SUMS, sums.T, strict=True)}
    assert x["words"] == [11, 0, 4, 0] and x["sure"] == [3, 0, 2, 0] and x["second"] == [3, 0, 0, 0] and x["near"] == [1, 0, 0, 0]
    assert x["shouted"] == [1, 0, 0, 0] and x["loud"] == [1, 0, 0, 0] and x["exclaims"] == [2, 0, 0, 0] and x["asks"] == [0, 0, 1, 0]
    assert x["unmasked"] == [2, 0, 1, 0] and x["digits"] == [2, 0, 0, 0] and x["upper"] == [5, 0, 0, 0]
    assert most.tolist() == [4, 0, 4, 0]
    assert np.isfinite(toxicity.features(sums, most)).all()


def test_long_texts_are_added_up(monkeypatch):
    monkeypatch.setattr(toxicity, "STRETCH", 30)
    text = " ".join(f"word{i} you" for i in range(50))
    parts, owner = toxicity.stretches([text, None, "x" * 100])
    assert " ".join(p.strip() for p in parts[:-2]) == text and owner.tolist() == [0] * (len(parts) - 2) + [1, 2]


def test_edges(spark, trained, tmp_path):
    _, _, model = trained
    texts = [None, "", " \n", "a", "💀" * 50, "idiot " * 300_000, "x" * 1_000_000, "same", "same"]
    rows = [(n, t, "s", 1.0, None) for n, t in enumerate(texts)] + [(None, "no id", "s", 1.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, features string, score double, prediction string")
    got = {r.doc_id: r for r in toxicity.predict(df, model, keep=["doc_id", "features"]).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values()) and got[7].score == got[8].score and got[5].score > 0.5
    assert toxicity.predict(df.limit(0), model).count() == 0


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(6)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([(0, None), (None, 1)], 0.0), ([(0, 1), (1, 1), (2, 0), (2, 1), (3, 0)], 0.75)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.predict(docs, model).collect()} == {share}


def test_query_columns(spark):
    out = queries.op12_toxicity(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.7) for r in rows)
