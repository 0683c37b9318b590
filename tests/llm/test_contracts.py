"""Each query against its plain version, on the smallest documents, edge cases and texts of its own."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codeloom.llm import queries

from . import oracles

SF = "/root/testdata/sf0.001"


def cases():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, line = prose(90), prose(9)
    near = line.split()
    return [
        None, "", "   \n\t ", "a", "A a\x0bA", "word " * 4000, "it's we'll 'S ''t  x 　y ½²³ ١٢٣ é́ \U0001f600\U0001f600  \n\n end  ",
        prose(30) + "\n" + passage + "\n" + prose(20), passage + " tail", "x" + passage, passage, passage,
        line + "\n" + prose(12) + "\n" + line.upper() + "\nshort line\nshort line", " ".join(near[:-1] + near[-1:] + ["more"]) + "\n\n" + line,
        "a.b@c.de, x@y.z. @n @n.o p@q..r ..s@t-u.v 1.2.3.4.5 256.1.1.1 10.0.0.255 1.2.3",
        "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 0000 0000 0000 12 34 +49 (30) 901820-5 +1 +123 +1234567890123456 +44.20.7946.0958",
        "퟿�" + "ß" * 300 + "é" * 210 + "ß" * 300, "<|endoftext|> <|startoftext|>", passage[:400] + prose(40) + passage[:400],
    ]


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """The smallest tables with the cases above appended, and columns that the operators use inside."""
    d = str(tmp_path_factory.mktemp("world"))
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text", "lang"]).to_pylist()
    start = max(x["doc_id"] for x in docs) + 7
    docs += [{"doc_id": start + 3 * n, "text": t, "lang": None if n % 2 else "en"} for n, t in enumerate(cases())]
    clash = {c: pa.array([n for n in range(len(docs))], pa.int64()) for c in ("row_id", "fp", "_text", "_id", "ids", "n_lines", "kept", "held_out", "component", "start", "spans")}
    table = pa.table({"doc_id": pa.array([x["doc_id"] for x in docs], pa.int64()), "text": [x["text"] for x in docs], "lang": pa.array([x["lang"] for x in docs], pa.string()), **clash})
    pq.write_table(table, f"{d}/documents.parquet", row_group_size=64)
    vectors = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    width = len(vectors[0]["embedding"])
    odd = [None, [None] + [0.5] * (width - 1), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [0.0] * width, [0.0] * width]
    vectors += [{"vec_id": 100_000 + 100 * n, "embedding": v} for n, v in enumerate(odd)]
    pq.write_table(pa.table({"vec_id": pa.array([v["vec_id"] for v in vectors], pa.int64()), "embedding": pa.array([v["embedding"] for v in vectors], pa.list_(pa.float32()))}), f"{d}/embeddings.parquet")
    os.symlink(f"{SF}/benchmark.parquet", f"{d}/benchmark.parquet")
    return d, [(x["doc_id"], x["text"]) for x in docs], [(v["vec_id"], v["embedding"]) for v in vectors]


PLAIN = {
    "op1_bpe": (oracles.bpe, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op4_wavelet": (oracles.wavelet, ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op5_pii": (oracles.private, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
    "op7_lines": (oracles.lines, ["doc_id", "n_lines", "n_removed", "kept_sha256"]),
    "op8_simhash": (oracles.simhash, ["doc_id", "fingerprint", "component_id"]),
    "op10_repeats": (oracles.repeats, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_equals_plain_version(spark, world, name):
    d, docs, _ = world
    plain, columns = PLAIN[name]
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, d).select(columns).collect())
    want = sorted(plain(docs))
    assert [g for g, w in zip(got, want, strict=True) if g != w][:3] == [w for g, w in zip(got, want, strict=True) if g != w][:3]


def test_top_k(spark, world):
    d, _, vectors = world
    got = sorted(tuple(r) for r in queries.op2_topk(spark, d).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(oracles.top(vectors))


def test_base_spans_are_among_all_spans(spark, world):
    for r in queries.op5_pii(spark, world[0]).collect():
        found = [s.split(":")[0] for s in r.spans.split(",") if s]
        assert found.count("email") >= r.n_email and found.count("ip") >= r.n_ip and found.count("card") >= r.n_card and found.count("phone") >= r.n_phone


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.op6_langid(spark, sf).join(docs, "doc_id").where("held_out and lang is not null and length(text) > 40").collect()
    assert len(found) > 100
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


def test_language_edges(spark, world):
    d, docs, _ = world
    found = {r.doc_id: r for r in queries.op6_langid(spark, d).collect()}
    assert len(found) == len(docs)
    for i, t in docs:
        assert 0 <= found[i].score <= 1
        assert (found[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def test_benchmark_passages_are_found(spark, world):
    d, _, _ = world
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    planted = {(i, n) for i, t in docs.items() for n, x in items.items() if x in t}
    found = {(r.doc_id, r.item_id) for r in queries.op9_decontam(spark, d).collect()}
    assert planted and planted <= found
    assert len({i for i, _ in found}) < len(docs) / 3


def test_repeated_passages_are_found(spark, world):
    """Every document that shares 60 words in a row with another is linked with it, directly or over others."""
    d, docs, _ = world
    found = {r.doc_id: r for r in queries.op3_passages(spark, d).collect()}
    assert len(found) == len(docs)
    where = {}
    for i, t in docs:
        w = oracles.ascii_words(t).split()
        for k in range(len(w) - 59):
            other = where.setdefault(" ".join(w[k : k + 60]), i)
            if other != i:
                assert found[i].class_id == found[other].class_id and found[i].n_links > 0
    assert sum(r.n_links == 0 for r in found.values()) > len(found) / 4


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("embeddings", "vec_id long, embedding array<float>"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_clean_documents(spark, world):
    import corpus_pipeline as p

    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("d")
    docs = spark.table("d")
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == p.COLUMNS
        sizes.append(docs.count())
    last = p.STAGES[-1][1](spark, docs, SF)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert last.where("not round_trip").count() == 0 and last.count() == sizes[-1]
