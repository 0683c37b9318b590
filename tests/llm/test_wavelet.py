"""Ids against the library for every letter near Latin, and the three queries of the matrix against plain lists."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codeloom.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_code_point_below_0250():
    library = Tokenizer.from_file(PATH)
    texts = [f"a{chr(c)}b {chr(c)}x1{chr(c)}! {chr(c)}{chr(c)}" for c in range(1, 0x250)]
    rng = random.Random(4)
    signs = [chr(c) for c in range(32, 0x250)] + ["'", "'s", "<|endoftext|>", " ", "\n", "́", "中", "½"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)]
    ids, counts = wavelet.encode_words(texts, PATH, 2)
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_access_rank_select():
    rng = np.random.default_rng(3)
    for n, top in ((1, 1), (700, 5), (5000, 40_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert m.all().tolist() == ids.tolist()
        for i in rng.integers(0, n, 30).tolist():
            token = int(ids[i])
            assert m.access(i) == token
            assert m.rank(token, i) == int((ids[:i] == token).sum())
            places = np.flatnonzero(ids == token)
            k = int(rng.integers(0, len(places)))
            assert m.select(token, k) == places[k] and m.select(token, len(places)) == -1
        assert m.rank(top + 1) == 0 and m.select(top + 1, 0) == -1


def test_tokens_where(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"house {'tree ' * (n % 5)}") for n in range(40)] + [(None, None), (3, "tree")], "doc_id long, text string")
    wavelet.write_shards(docs, f"{tmp_path}/shards", PATH, end_id=2, shard_ids=30)
    tree = int(wavelet.encode_words(["tree"], PATH, 2)[0][0])
    found = wavelet.tokens_where(spark, f"{tmp_path}/shards", tree).collect()
    assert len(found) > 2 and sum(r.n for r in found) == sum(n % 5 for n in range(40)) + 1
    assert all((r["first"] >= 0) == (r.n > 0) for r in found)
