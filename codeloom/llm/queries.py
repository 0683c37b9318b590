"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, langid, lines, passages, pii, repair, repeats, simhash, topk, toxicity, wavelet
from .common import shared_dir, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest_ids("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_passages(table(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select("doc_id", "class_id", "n_links", "n_repeated_words", told.alias("spans"))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return wavelet.read_shards(spark, path)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8, min_words=5)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs_ratio", "answer_ratio")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations"), out_of=20))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs, labels = (table(spark, sf_dir, name).withColumn("held_out", held_out) for name in ("documents", "labels"))
    model = toxicity.fit(docs.where("not held_out"), labels.where("not held_out"))
    found = toxicity.predict(docs, model, keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, scale=1_000_000_000, top=200)


QUERIES = {"op1_bpe": op1_bpe, "op2_topk": op2_topk, "op3_passages": op3_passages, "op4_wavelet": op4_wavelet, "op5_pii": op5_pii, "op6_langid": op6_langid, "op7_lines": op7_lines, "op8_simhash": op8_simhash, "op9_decontam": op9_decontam, "op10_repeats": op10_repeats, "op11_repair": op11_repair, "op12_toxicity": op12_toxicity, "op13_divergence": op13_divergence}

def _more(x: str, cost: str, letter: str) -> str:
    """SQL for edits ``x``, nine digits of cost and the letters, with one more; least() of such strings is the cheapest, then
    the ASCII-least."""
    return f"lpad(CAST(CAST({x}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {x}[10:] || '{letter}'"


def _repair_sql() -> str:
    """Edits for each of four states (nothing, s, u, a written last) are carried over the rows of a conversation; ``b`` is
    a row as [role, fault]."""
    user = f"least(s[3], {_more('s[1]', '3', 'I')}, {_more('s[2]', '3', 'I')}, {_more('s[4]', '3', 'I')})"
    assistant = f"least(s[4], {_more(f'({user})', '3', 'I')})"
    now = ["s[1]", "s[2]", f"({user})", f"({assistant})"]
    late = "(CASE b[2] WHEN 'truncated' THEN 3 ELSE 0 END)"

    def kept(x: str, role: str) -> str:
        return f"CASE WHEN b[1] = '{role}' AND b[2] IN ('', 'truncated') THEN {_more(x, late, 'K')} END"

    def renamed(x: str) -> str:
        return f"CASE WHEN b[2] IN ('', 'truncated') THEN {_more(x, f'3 + {late}', 'R')} END"

    then = [
        _more(now[0], "4", "D"),
        f"least({_more(now[1], '4', 'D')}, {kept(now[0], 's')})",
        f"least({_more(now[2], '4', 'D')}, {', '.join(f(now[k]) for k in (0, 1, 3) for f in (renamed, lambda x: kept(x, 'u')))})",
        f"least({_more(now[3], '4', 'D')}, {renamed(now[2])}, {kept(now[2], 'a')})",
    ]
    return rf"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), fates AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)),
                                   lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate
            FROM conversations, crc
        ), hurt AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM fates
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
        ), shaped AS (
            SELECT conv_id, turn, role, text, i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM placed
        ), faults AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM shaped
        ), whole AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                   list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts, list([left(role, 1), fault] ORDER BY i) AS steps
            FROM faults GROUP BY conv_id
        ), ways AS (
            SELECT *, list_reduce([['000000000', NULL, NULL, NULL]::VARCHAR[]] || steps, lambda s, b: [{", ".join(then)}]) AS s FROM whole
        ), least_ AS (
            SELECT *, least(s[1], {now[3]}) AS best FROM ways
        ), edits AS (
            SELECT *, best[10:] AS audit, CAST(best[1:9] AS BIGINT) AS cost, string_split(best[10:], '') AS letters FROM least_
        ), kept AS (
            SELECT *, list_filter(list_transform(range(1, len(audit) + 1), lambda j: {{'letter': audit[j:j], 'row': len(replace(audit[1:j], 'I', '')), 'place': len(replace(audit[1:j], 'D', ''))}}), lambda e: e.letter <> 'D') AS out FROM edits
        ), lines AS (
            SELECT *, CASE WHEN out[1].letter = 'K' AND left(roles[out[1].row], 1) = 's' THEN 1 ELSE 0 END AS system FROM kept
        ), hashed AS (
            SELECT *, sha256(array_to_string(list_transform(out, lambda e:
                     CASE WHEN e.letter = 'K' THEN roles[e.row] WHEN (e.place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.letter = 'I' THEN '' ELSE texts[e.row] END), chr(10))) AS repaired_sha256
            FROM lines
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN hashed h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
    """


ORACLE_SQL = {
    "op11_repair": _repair_sql(),
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (
            SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op13_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS n,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), w AS (
            SELECT lang, source, term, count(*) AS c, count(DISTINCT n) AS docs FROM (SELECT lang, source, n, unnest(words) AS term FROM d) GROUP BY ALL
        ), kept AS (
            SELECT lang, term, sum(c) AS c FROM w GROUP BY ALL HAVING sum(docs) >= 3
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), dense AS (
            SELECT g.lang, g.source, k.term, k.c AS all_c, coalesce(w.c, 0) AS c
            FROM g JOIN kept k USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term
        ), shares AS (
            SELECT lang, source, term, c,
                   1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (all_c + 1)) // (sum(all_c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS q
            FROM dense
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
