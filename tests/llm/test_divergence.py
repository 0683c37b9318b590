"""The divergence audit against plain sums over the whole vocabulary."""

import re
from collections import Counter, defaultdict

from codeloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, item string, value string"


def plain(docs, least=3, scale=10**9, top=200):
    count, have, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in d) for d in docs):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count[lang, source].update(words)
        have[lang].update(set(words))
        langs[lang].add(source)
    rows = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in have[lang].items() if n >= least)

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + scale * (c[t] + 1) // whole for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for n, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    rows.append((lang, s, part, item, value, n))
    return sorted(rows)


def run(spark, docs, **more):
    rows = [(n, t, lang, s, n, "x", None, "y") for n, (t, lang, s) in enumerate(docs)]
    df = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_plain_sums(spark):
    docs = [("Über über Ab-ab 12 ab_C c\x00d é!x", "de", "a"), ("ab c über  \x7fd", "de", "b"), ("AB C d ÜBER", "de", None), (None, "de", "silent")] * 2
    docs += [("x y", "en", "a"), ("x z", "en", "b"), ("x x x w", "en", "b"), ("x", None, "a"), ("x", "", "a"), ("x y", None, None), ("rare words here", "fr", "a"), ("", "fr", "b"), (None, None, None)]
    docs += [("tie one two three four five", "es", s) for s in ("k", "l", "m")] * 2
    assert run(spark, docs) == plain(docs)
    assert run(spark, docs, top=2, least_docs=2) == plain(docs, top=2, least=2)


def test_long_texts_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 50)
    docs = [(" ".join(f"w{'abcdefgh'[(i * k) % 8]}{'xyz'[i % 3]}" for i in range(300 * (s == "hot") + 20)) + "É" * 200, "en", s) for s in ("hot", "b", "c") for k in (1, 3, 5)]
    assert run(spark, docs) == plain(docs)
    assert list(divergence._counted(iter([]))) == []
    text = "aé " * 100 + "long" * 40 + " b"
    assert [w.decode() for part in divergence.terms_of(text) for w in part] == text.split()


def test_empty(spark):
    assert run(spark, []) == []


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.share(F.lit(900_000_000_000), F.lit(2_000_000_000_001), 10**9).alias("p")).first().p
    assert got == 1 + 10**9 * 900_000_000_001 // 2_000_000_000_001
