"""Rare labels take nothing from the other languages."""

import random

from codeloom.llm import langid


def texts():
    rng = random.Random(9)
    out = []
    for lang in ("aa", "bb", "cc"):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(4, 6))) for _ in range(900)]
        out += [(n, " ".join(rng.choices(words, k=60)), lang) for n in range(len(out), len(out) + 80)]
    return out


def test_label_with_one_short_document(spark):
    docs = texts()
    learn = [d for d in docs if d[0] % 2] + [(1000, "zz yy", "xx")]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(learn, schema))
    assert model.labels == ["aa", "bb", "cc", "xx"]
    kept = [d for d in docs if d[0] % 2 == 0]
    found = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(kept, schema), model).collect()}
    assert sum(found[i] == lang for i, _, lang in kept) / len(kept) > 0.95


def test_bounds_are_taken_per_language(spark, monkeypatch):
    docs = [(n, "word", f"l{n % 5}") for n in range(500)] + [(900 + n, "word", "rare") for n in range(20)]
    told = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: told.extend(langs))
    langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), per_language=20, max_languages=6)
    assert told.count("rare") == 20 and all(told.count(f"l{n}") <= 20 for n in range(5))
