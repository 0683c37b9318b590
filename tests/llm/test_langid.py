"""Letters decide what is undetermined; pieces of chains give the marginals of whole chains; switches are found."""

import numpy as np

from codeloom.llm import langid


def test_letters_decide(spark):
    words = {"aa": "dolor lorem ipsum amet sit consectetur", "bb": "zug hauf krieg stein wald berg"}
    train = [(n, (words[k] + " ") * 12, k) for n in range(30) for k in words]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    texts = ["a½", "x²", "½ " * 9, "½", "12 34", "", None, "w" * 300, "字", "dolor amet zug"]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
        assert 0 <= got[i].score <= 1 and (got[i].score > 0 or got[i].lang_pred == "und")


def test_pieces_equal_whole_chains():
    rng = np.random.default_rng(8)
    lengths = np.array([1, 3, 64, 65, 200, 7, 128, 129, 1000])
    scores = rng.normal(0, 2, (int(lengths.sum()), 3)).astype(np.float32)
    move = rng.normal(0, 1, (3, 3)).astype(np.float32)
    got = langid.marginals(scores, lengths, move)
    at = 0
    for n in lengths:
        p, m = np.exp(scores[at : at + n].astype(float)), np.exp(move.astype(float))
        f, b = np.zeros((n, 3)), np.ones((n, 3))
        for t in range(n):
            f[t] = p[t] * (f[t - 1] @ m if t else 1)
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = m @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = f * b
        assert np.abs(got[at : at + n] - want / want.sum(axis=1, keepdims=True)).max() < 1e-4
        at += n


def test_code_switched_words_are_labelled():
    rng = np.random.default_rng(2)
    words = {k: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(120)] for k, letters in {"aa": "aeioulrnst", "bb": "ghkzwpfbxy"}.items()}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    model = langid.train([text(k, 200) for _ in range(20) for k in words], [k for _ in range(20) for k in words])
    assert model.lexicon.size > 100 and model.member.shape[1] == 2
    mixed = langid.CodeWords([text("aa", 15) + " " + text("bb", 15) + " " + text("aa", 15)], "alpha")
    label = langid.marginals(model.emissions(mixed), mixed.counts, model.transition).argmax(axis=1)
    assert (label == np.repeat([0, 1, 0], 15)).mean() > 0.95
