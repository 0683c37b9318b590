"""Personal data by weak supervision, in DataFrame functions only.

Regex, gazetteer and context labelers vote on every candidate span. Expectation-maximisation over the table of vote
patterns estimates how reliable each labeler is; its posteriors then train a naive Bayes span classifier. Spans that
match a base definition are always kept; the classifier decides on the looser candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
#: Possessive forms of the base definitions: the same leftmost matches, without backtracking over long runs.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    CARD: r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes that the base definitions do not cover.
LOOSE = {
    PHONE: r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])",
    SECRET: r"(?<![A-Za-z0-9])[A-Za-z_]{2,24}\x20?[=:]\x20?[\"'][A-Za-z0-9_/+=-]{16,128}[\"']",
}
#: Cheap tests before the patterns run.
GATE = {
    EMAIL: lambda t: F.contains(t, F.lit("@")),
    IP: lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    CARD: lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    PHONE: lambda t: F.contains(t, F.lit("+")),
}
LOOSE_GATE = {PHONE: lambda t: t.rlike(r"[0-9]{3}-[0-9]{4}"), SECRET: lambda t: t.rlike(r"[=:]\x20?[\"'][A-Za-z0-9_/+=-]{16}")}
LABELERS = 5
#: Buckets of the word before a span, a feature of the classifier.
WORD_BUCKETS = 32
LEFT, RIGHT = 24, 8


@dataclass(frozen=True)
class Gazetteers:
    """Word lists of the gazetteer and context labelers; all are parameters."""

    domains: tuple[str, ...] = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us")
    card_starts: tuple[str, ...] = ("3", "4", "5", "6")
    calling_codes: tuple[str, ...] = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "90", "91")
    secret_names: tuple[str, ...] = ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential")
    cues: dict[int, tuple[str, ...]] = field(
        default_factory=lambda: {
            EMAIL: ("mail", "contact", "write", "correo"),
            IP: ("ip", "host", "server", "address", "addr"),
            CARD: ("card", "visa", "master", "credit", "karte", "carte", "tarjeta"),
            PHONE: ("call", "tel", "phone", "fon", "mobile", "fax"),
            SECRET: ("api", "aws", "export", "config", "env"),
        }
    )
    against: tuple[str, ...] = ("version", "isbn", "page", "section", "build", "figure")


def _located(gaps: Column, gap_sizes: Column, hits: Column, hit_sizes: Column, kind: int, base: bool) -> Column:
    """Structs ``(start, k, end, hit, before, after, base)``: gaps and hits alternate, so sizes give the places."""

    def add(t: Column, x: Column) -> Column:
        return t + x

    def one(hit: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(gap_sizes, F.lit(1), i + 1), F.lit(0), add) + F.aggregate(F.slice(hit_sizes, F.lit(1), i), F.lit(0), add)
        return F.struct(
            start.alias("start"), F.lit(kind).alias("k"), (start + F.get(hit_sizes, i)).alias("end"), hit.alias("hit"),
            F.right(F.get(gaps, i), F.lit(LEFT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(RIGHT)).alias("after"), F.lit(base).alias("base"),
        )

    return F.transform(hits, one)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    d = _digits(hit)

    def add(t: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return t + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _sign(x: Column) -> Column:
    """The kind of one sign: none, space, letter, digit, quote, bracket or other."""
    told = F.when(x == "", "none").when(x.rlike(r"\s"), "space").when(x.rlike(r"\p{L}"), "letter").when(x.rlike("[0-9]"), "digit")
    return told.when(x.rlike("[\"'`]"), "quote").when(x.rlike(r"[()\[\]{}<>]"), "bracket").otherwise("other")


def _valid(c: Column) -> Column:
    """The check that belongs to a kind: octets, digit count and checksum, digit count."""
    n = F.length(_digits(c["hit"]))
    octets = F.forall(F.split(c["hit"], r"\."), lambda x: x.cast("double") <= 255)
    return (
        F.when(c["k"] == IP, octets)
        .when(c["k"] == CARD, F.when(n.between(12, 19), _luhn(c["hit"])).otherwise(False))
        .when(c["k"] == PHONE, n.between(9, 15))
        .otherwise(True)
    )


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``found array<struct>`` of base and looser spans in code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    passes = [(k, True, BASE[k], GATE[k]) for k in BASE] + [(k, False, LOOSE[k], LOOSE_GATE[k]) for k in LOOSE]
    source = docs.select(F.col(id_column).alias("_id"), t.alias("_t"))
    gated = source.select("_id", "_t", *[gate(F.col("_t")).alias(f"o{i}") for i, (*_, gate) in enumerate(passes)])
    cut_up = gated.select(
        "_id",
        *[F.when(F.col(f"o{i}"), F.split("_t", p, -1)).otherwise(none).alias(f"g{i}") for i, (_, _, p, _) in enumerate(passes)],
        *[F.when(F.col(f"o{i}"), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(none).alias(f"h{i}") for i, (_, _, p, _) in enumerate(passes)],
    )
    sized = cut_up.select("*", *[F.transform(f"{x}{i}", F.length).alias(f"n{x}{i}") for x in "gh" for i in range(len(passes))])
    parts = [F.filter(_located(F.col(f"g{i}"), F.col(f"ng{i}"), F.col(f"h{i}"), F.col(f"nh{i}"), k, base), lambda c: (c["k"] != CARD) | (F.length(c["hit"]) >= 12)) for i, (k, base, _, _) in enumerate(passes)]
    return sized.select("_id", F.concat(*parts).alias("found"))


def judged(found: DataFrame, lists: Gazetteers) -> DataFrame:
    """Replace each candidate by ``(start, k, end, base, valid, v, size, near)``: v are the votes -1, 0, 1 of the labelers,
    near the context that only the classifier sees: the bucket of the word before, the kinds of the signs on both sides.
    Spans that overlap a kept base span go; matches that fail their check stay as evidence only."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    one_of = lambda x, words: x.isin(*words)
    has = lambda x, words: x.rlike("(?i)(" + "|".join(words) + ")")

    def look(c: Column) -> Column:
        hit, k = c["hit"], c["k"]
        valid = _valid(c)
        code = F.regexp_extract(hit, r"^\+([0-9]+)", 1)
        listed = (
            F.when(k == EMAIL, one_of(F.lower(F.regexp_extract(hit, r"\.([^.]*)$", 1)), lists.domains))
            .when(k == IP, ~hit.rlike(r"^0*(0|127|255)\."))
            .when(k == CARD, one_of(F.left(hit, F.lit(1)), lists.card_starts))
            # Without a calling code this labeler abstains.
            .when(k == PHONE, F.when(code != "", F.exists(F.array(*[F.left(code, F.lit(n)) for n in (1, 2, 3)]), lambda x: one_of(x, lists.calling_codes))))
            .otherwise(has(F.regexp_extract(hit, "^[A-Za-z_]+", 0), lists.secret_names))
        )
        cue = F.lit(False)
        for kind, words in lists.cues.items():
            cue = F.when(k == kind, has(c["before"], words)).otherwise(cue)
        edge = F.right(c["before"], F.lit(1)).rlike(r"[\p{L}\p{N}]") | F.left(c["after"], F.lit(1)).rlike(r"[\p{L}\p{N}]")
        votes = F.array(
            F.when(c["base"], 1).otherwise(0),
            vote(valid, ~valid),
            vote(listed, ~listed),
            vote(cue, has(c["before"], lists.against)),
            vote(~edge, edge),
        )
        size = F.least(F.length(_digits(hit)), F.lit(20))
        word = F.lower(F.regexp_extract(c["before"], r"(\p{L}+)[^\p{L}]*$", 1))
        bucket = F.when(word == "", "none").otherwise(F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string"))
        near = F.array(F.concat(F.lit("w:"), bucket), F.concat(F.lit("b:"), _sign(F.right(c["before"], F.lit(1)))), F.concat(F.lit("a:"), _sign(F.left(c["after"], F.lit(1)))))
        return F.struct(c["start"], c["k"], c["end"], (c["base"] & valid).alias("base"), valid.alias("valid"), F.transform(votes, lambda v: F.coalesce(v, F.lit(0))).alias("v"), size.alias("size"), near.alias("near"))

    voted = found.select("_id", F.transform("found", look).alias("c"))
    sure = voted.select("_id", "c", F.filter("c", lambda c: c["base"]).alias("sure"))
    free = lambda c: c["base"] | ~F.exists("sure", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return sure.select("_id", F.filter("c", free).alias("c"))


#: One round of expectation-maximisation: m holds prior per kind, a = P(vote 1 | span), b = P(vote -1 | no span).
_ROUND = """
aggregate(sequence(1, {rounds}),
  named_struct('prior', array_repeat(0.5D, {kinds}), 'a', array_repeat(0.8D, {labelers}), 'b', array_repeat(0.7D, {labelers})),
  (m, _) -> transform(array(transform(pats, p -> named_struct('k', p.k, 'v', p.v, 'n', p.n, 'y',
      1D / (1D + exp(-(ln(m.prior[p.k] / (1D - m.prior[p.k])) + aggregate(sequence(0, {labelers} - 1), 0D, (t, j) -> t + CASE
        WHEN p.v[j] = 1 THEN ln(m.a[j] / (1D - m.b[j])) WHEN p.v[j] = -1 THEN ln((1D - m.a[j]) / m.b[j]) ELSE 0D END))))))),
    s -> named_struct(
      'prior', transform(sequence(0, {kinds} - 1), k -> (1D + aggregate(s, 0D, (t, x) -> t + IF(x.k = k, x.n * x.y, 0D))) / (2D + aggregate(s, 0D, (t, x) -> t + IF(x.k = k, x.n, 0D)))),
      'a', transform(sequence(0, {labelers} - 1), j -> (4D + aggregate(s, 0D, (t, x) -> t + IF(x.v[j] = 1, x.n * x.y, 0D))) / (5D + aggregate(s, 0D, (t, x) -> t + IF(x.v[j] <> 0, x.n * x.y, 0D)))),
      'b', transform(sequence(0, {labelers} - 1), j -> (4D + aggregate(s, 0D, (t, x) -> t + IF(x.v[j] = -1, x.n * (1D - x.y), 0D))) / (5D + aggregate(s, 0D, (t, x) -> t + IF(x.v[j] <> 0, x.n * (1D - x.y), 0D))))))[0])
"""


def reliabilities(spans: DataFrame, rounds: int = 20) -> DataFrame:
    """One row ``m struct<prior, a, b>`` from ``(k, v)`` of all candidates.

    The pattern table has at most kinds * 3^labelers rows whatever the corpus; EM runs over it as one expression.
    """
    pats = spans.groupBy("k", "v").agg(F.count("*").cast("double").alias("n"))
    row = pats.agg(F.array_sort(F.collect_list(F.struct("k", "v", "n"))).alias("pats"))
    return row.select(F.expr(_ROUND.format(rounds=rounds, kinds=len(KINDS), labelers=LABELERS)).alias("m"))


def _posterior(k: Column, v: Column, m: dict) -> Column:
    prior = F.element_at(F.array(*[F.lit(math.log(p / (1 - p))) for p in m["prior"]]), k + 1)
    for j in range(LABELERS):
        a, b = m["a"][j], m["b"][j]
        prior = prior + F.when(F.get(v, F.lit(j)) == 1, math.log(a / (1 - b))).when(F.get(v, F.lit(j)) == -1, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-prior))


def _features(c: Column) -> Column:
    """Names of the classifier's features of a span: votes, digits and context by kind; at most some hundred in all."""
    votes = [F.concat(F.lit(f"v{j}:"), c["k"].cast("string"), F.lit(":"), F.get(c["v"], F.lit(j)).cast("string")) for j in range(LABELERS)]
    own = F.array(*votes, F.concat(F.lit("n:"), c["k"].cast("string"), F.lit(":"), c["size"].cast("string")))
    return F.concat(own, F.transform(c["near"], lambda x: F.concat(c["k"].cast("string"), F.lit(":"), x)))


def detect(docs: DataFrame, lists: Gazetteers | None = None, threshold: float = 0.9, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``base`` and ``spans``, arrays of ``struct<start int, k int, end int>`` by start.

    ``k`` indexes KINDS, places are code points, ends exclusive. ``base`` are the spans of the base definitions;
    ``spans`` adds candidates whose classifier probability reaches ``threshold``. A null or empty text has none;
    repeated rows stay; an empty table gives no rows. The documents are scanned once and nothing of them is shuffled:
    the counts that train the model are partial sums, and the model is some hundred numbers.
    """
    lists = lists or Gazetteers()
    held = cut(judged(candidates(docs, id_column, text), lists), "spans")
    each = held.select(F.explode("c").alias("c"))
    m = reliabilities(each.select("c.k", "c.v")).first()
    weights, bias = {}, 0.0
    if m is not None and m["m"] is not None:
        model = m["m"].asDict(recursive=True)
        y = _posterior(F.col("c")["k"], F.col("c")["v"], model)
        counted = each.select(F.explode(F.concat(F.array(F.lit("all")), _features(F.col("c")))).alias("f"), y.alias("y")).groupBy("f").agg(F.sum("y").alias("y"), F.sum(1 - F.col("y")).alias("z"))
        all_y = F.max(F.when(F.col("f") == "all", F.col("y")))
        total = counted.agg(all_y.alias("y"), F.max(F.when(F.col("f") == "all", F.col("z"))).alias("z")).first()
        if total["y"] is not None:
            logs = F.log((F.col("y") + 0.5) / F.lit(total["y"] + 1)) - F.log((F.col("z") + 0.5) / F.lit(total["z"] + 1))
            weights = {r["f"]: r["w"] for r in counted.where("f <> 'all'").select("f", logs.alias("w")).toLocalIterator()}
            bias = math.log((total["y"] + 1) / (total["z"] + 1))
    bare = lambda c: F.struct(c["start"], c["k"], c["end"])
    base = F.array_sort(F.transform(F.filter("c", lambda c: c["base"]), bare))
    if weights:
        known = F.create_map(*[x for f, w in sorted(weights.items()) for x in (F.lit(f), F.lit(float(w)))])
        log_odds = lambda c: F.aggregate(_features(c), F.lit(float(bias)), lambda t, f: t + F.coalesce(F.try_element_at(known, f), F.lit(0.0)))
        kept = F.filter("c", lambda c: c["base"] | (c["valid"] & (1 / (1 + F.exp(-log_odds(c))) >= threshold)))
    else:
        kept = F.filter("c", lambda c: c["base"])
    return held.select(F.col("_id").alias(id_column), base.alias("base"), F.array_sort(F.transform(kept, bare)).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["k"] == kind)).cast("long")
