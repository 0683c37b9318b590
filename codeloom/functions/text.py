"""Column functions over text: identifier tokens, stems and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import _c

def identifier_tokens(text: str | Column) -> Column:
    """Lower-case parts of an identifier: split at ``_ . ( ) ,`` and white space, and where a capital follows another sign."""
    split = F.regexp_replace(F.regexp_replace(_c(text), r"(?<=[^\p{Lu}])(?=\p{Lu})", " "), r"[_.(),\s]+", " ")
    return F.filter(F.split(F.lower(F.trim(split)), " "), lambda x: x != "")


def term_tokens(text: str | Column, least: int = 3, most: int = 12) -> Column:
    """Distinct tokens of letters and digits of at least ``least`` signs, the longest ``most`` (then by name)."""
    camel = F.lower(F.regexp_replace(_c(text), r"(?<=[^\p{Lu}])(?=\p{Lu})", " "))
    found = F.array_distinct(F.regexp_extract_all(camel, F.lit(rf"[\p{{L}}\p{{N}}]{{{least},}}"), F.lit(0)))
    ranked = F.sort_array(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    return F.transform(F.slice(ranked, 1, most), lambda s: s["x"])


def question_words(text: str | Column, stop_words: list[str] = ()) -> Column:
    """Words of a question without the given stop words, first occurrence first."""
    words = F.transform(F.regexp_extract_all(_c(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)
    none = F.expr("cast(array() as array<string>)")
    return F.array_except(words, F.array(*[F.lit(w) for w in stop_words]) if stop_words else none)


def stems(words: str | Column) -> Column:
    """Each word, and without its last two signs if it has six or more."""
    return F.array_distinct(F.flatten(F.transform(_c(words), lambda w: F.when(F.length(w) >= 6, F.array(w, F.left(w, F.length(w) - 2))).otherwise(F.array(w)))))


def same_stem(a: str | Column, b: str | Column) -> Column:
    """Whether two words share a prefix of max(3, min(shorter - 1, 5)) signs."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    need = F.greatest(F.lit(3), F.least(F.least(F.length(a), F.length(b)) - 1, F.lit(5)))
    return (F.length(a) >= need) & (F.length(b) >= need) & (F.left(a, need) == F.left(b, need))


def plain_topic(html: str | Column, most: int = 10_000) -> Column:
    """``struct<title, text>`` of a help page: the first heading or title, and the text without tags in single spaces."""
    h = _c(html)
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def bare(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"(?is)<(script|style|nav)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
        for name, sign in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
            x = F.replace(x, F.lit(f"&{name};"), F.lit(sign))
        return clean(x)

    title = F.coalesce(*[F.nullif(bare(F.regexp_extract(h, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("h1", "h2", "title")])
    return F.struct(title.alias("title"), F.left(bare(h), F.lit(most)).alias("text"))
