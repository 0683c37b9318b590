"""Toxicity of texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of words from a lexicon that is learned from the labels, how near these stand to the second
person, capitals, punctuation, and signs of obfuscation (letters replaced by digits or signs, spread, or drawn out). The
lexicon holds whole words and first letters of words, as insults are inflected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, drop_cut
from .tokens import MIX, CodeWords, classes, mix

#: Folds of the training rows: the trees see the first ones, the calibration the others.
FOLDS, TREES = 6, 4
#: Letters of the beginnings that the lexicon may hold beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Entries of the lexicon at most: those that most toxic training rows have.
ENTRIES = 65_536
#: Signs of a text that are looked at together; a longer text is cut between two words and its sums are added up.
STRETCH = 1 << 19
#: Words around a hit in which the second person counts as near.
NEAR = 5
#: The second person in the languages at hand; signs that stand for letters.
SECOND = "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
LEET = dict(zip("013457@$!|+", "oieastasilt", strict=True))
SUMS = ("words", "letters", "upper", "signs", "exclaims", "asks", "digits", "shouted", "score", "some", "many", "sure", "second", "near", "odd", "unmasked", "drawn", "loud", "size")


@dataclass
class Lexicon:
    """Hashes in order, and for each of them how much it speaks for toxicity, a column for each fold left out and one for
    all folds."""

    keys: np.ndarray
    weight: np.ndarray

    def score(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """The greatest weight of each word's entries."""
        out = np.zeros(len(start), np.float32)
        if len(self.keys):
            for which, hashes in entries(codes, start, stop):
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == hashes)
                out[which[hit]] = np.maximum(out[which[hit]], self.weight[at[hit], fold[which[hit]]])
        return out


def _hashes(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    words = CodeWords.__new__(CodeWords)
    words.codes, words.start, words.stop = codes, start, stop
    return words.hashes()


def entries(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words that have it, hashes) of whole words and of each length of their beginnings."""
    yield np.arange(len(start)), _hashes(codes, start, stop)
    for n in BEGINNINGS:
        which = np.flatnonzero(stop - start > n)
        yield which, mix(_hashes(codes, start[which], start[which] + n) + np.uint64(n * int(MIX) % 2**64))


def stretches(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Texts in pieces of bounded size that end at white space, and the text of each piece; every text has one at least."""
    parts, owner = [], []
    for n, t in enumerate(texts):
        t, at = t or "", 0
        while len(t) - at > STRETCH and (gap := re.compile(r"\s").search(t, at + STRETCH)):
            parts.append(t[at : gap.start()])
            owner.append(n)
            at = gap.start()
        parts.append(t[at:])
        owner.append(n)
    return parts, np.array(owner, np.int64)


class Signs:
    """Code points of some pieces of text, each with a line end behind it, and their words, runs of letters."""

    def __init__(self, parts: list[str]):
        inside, low = classes("alpha")
        self.raw = np.frombuffer(("\n" + "".join(p + "\n" for p in parts)).encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes, self.letter = low[self.raw], inside[self.raw]
        self.begin = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]]) if parts else np.zeros(0, np.int64)
        edge = np.flatnonzero(self.letter[1:] != self.letter[:-1]) + 1
        self.start, self.stop = edge[::2], edge[1::2]
        self.owner = np.searchsorted(self.begin, self.start, "right") - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.float64), self.begin)


def _unmasked(s: Signs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words behind obfuscated ones, as (codes, start, stop, piece): tokens with signs between letters or with letters drawn
    out, and four or more single letters in a row."""
    blank = (s.raw <= 32) | (s.raw == 0xA0)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    place = np.flatnonzero(s.letter)
    upto = np.concatenate([[0], np.cumsum(s.letter)])
    same = np.zeros(len(s.codes) + 1, bool)
    same[2:-1] = s.letter[2:] & (s.codes[2:] == s.codes[1:-1]) & (s.codes[1:-1] == s.codes[:-2])
    drawn = np.concatenate([[0], np.cumsum(same[:-1])])
    many = upto[stop] - upto[start]
    some = np.flatnonzero(many > 1)
    first, last = place[upto[start[some]]], place[upto[stop[some]] - 1] + 1
    odd = (last - first > many[some]) | (drawn[last] > drawn[first])
    first, last = first[odd], last[odd]
    size = last - first
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    table = np.arange(128, dtype=np.uint32)
    for a, b in LEET.items():
        table[ord(a)] = ord(b)
    c = s.codes[at]
    c = np.where(c < 128, table[np.minimum(c, 127)], c)
    keep = classes("alpha")[0][c] & ~same[at] & ~(same[at + 1] & (at > 0))
    # Of a letter drawn out the third and later ones go by the first rule, the second one by the other.
    length = np.add.reduceat(keep, np.cumsum(size) - size) if len(size) else np.zeros(0, np.int64)
    owner = np.searchsorted(s.begin, first, "right") - 1
    alone = (s.stop - s.start == 1) & blank[s.start - 1] & blank[s.stop]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], alone, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    a, b = a[b - a > 3], b[b - a > 3]
    spread = np.concatenate([np.zeros(0, np.int64), *[np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]])
    codes = np.concatenate([c[keep], s.codes[s.start[spread]]])
    length = np.concatenate([length, b - a]).astype(np.int64)
    ends = np.cumsum(length)
    return codes, ends - length, ends, np.concatenate([owner, s.owner[a]])


def measured(parts: list[str], lexicon: Lexicon, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (a column for each of ``SUMS``) and the greatest weight of a word for each piece; ``fold`` is left out of the lexicon."""
    s = Signs(parts)
    n, size = len(parts), s.stop - s.start
    digit = (s.raw >= 48) & (s.raw <= 57)
    score = lexicon.score(s.codes, s.start, s.stop, fold[s.owner])
    upper = s.letter & (s.raw != s.codes)
    loud = np.add.reduceat(upper, s.start) if len(size) else np.zeros(0)
    # Between two starts there are no capitals but those of the word.
    shouted = (loud == size) & (size > 1)
    you = np.isin(_hashes(s.codes, s.start, s.stop), SECOND_HASHES)
    upto = np.concatenate([[0], np.cumsum(you)])
    low, high = np.searchsorted(s.owner, np.arange(n)), np.searchsorted(s.owner, np.arange(n), "right")
    index = np.arange(len(size))
    near = upto[np.minimum(index + NEAR + 1, high[s.owner])] > upto[np.maximum(index - NEAR, low[s.owner])]
    codes, start, stop, owner = _unmasked(s)
    full = stop > start
    hidden = np.zeros(len(start), np.float32)
    hidden[full] = lexicon.score(codes, start[full], stop[full], fold[owner[full]])
    drawn = np.zeros(len(s.raw), bool)
    drawn[2:] = (s.raw[2:] > 32) & (s.raw[2:] == s.raw[1:-1]) & (s.raw[1:-1] == s.raw[:-2])

    def by_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(s.owner, x, n)

    def hits(least: float) -> np.ndarray:
        """Of words as they stand and of those behind obfuscated ones."""
        return by_word(score > least) + np.bincount(owner, hidden > least, n)

    out = np.stack([
        by_word(np.ones(len(size))), s.sums(s.letter), s.sums(upper), s.sums(~s.letter & ~digit & (s.raw > 32)), s.sums(s.raw == 33), s.sums(s.raw == 63), s.sums(digit),
        by_word(shouted), by_word(score) + np.bincount(owner, hidden, n), hits(0.7), hits(2), hits(3), by_word(you), by_word(near & (score > 2)),
        np.bincount(owner, minlength=n).astype(float), np.bincount(owner, hidden > 2, n), s.sums(drawn), by_word(shouted & (score > 2)), np.array([len(p) for p in parts], float),
    ], axis=1)
    most = np.zeros(n, np.float32)
    np.maximum.at(most, s.owner, score)
    np.maximum.at(most, owner, hidden)
    return out, most


def features(sums: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Densities and logarithms of the counts of each text."""
    x = dict(zip(SUMS, sums.T, strict=True))
    words, hits = np.maximum(x["words"], 1), np.maximum(x["many"], 1)
    rates = [x[k] / words for k in ("exclaims", "asks", "digits", "shouted", "score", "some", "many", "sure", "second", "odd", "unmasked", "drawn")]
    counts = [np.log1p(x[k]) for k in ("words", "some", "many", "sure", "near", "unmasked", "loud")]
    return np.stack([*rates, *counts, x["upper"] / np.maximum(x["letters"], 1), x["signs"] / np.maximum(x["size"], 1), x["near"] / hits, x["unmasked"] / hits, most], axis=1)


SECOND_HASHES = CodeWords([" ".join(SECOND)], "alpha").hashes()


def with_features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows(_row, _text, _fold)`` with ``features array<double>`` in place of the text; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # bounded: ENTRIES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                one = batch.slice(a, b - a)
                parts, owner = stretches(one.column(1).to_pylist())
                fold = one.column(2).to_numpy(zero_copy_only=False)[owner]
                sums, most = np.zeros((len(one), len(SUMS))), np.zeros(len(one), np.float32)
                at = 0
                while at < len(parts):
                    end, size = at, 0
                    while end < len(parts) and (end == at or size + len(parts[end]) <= 2 * STRETCH):
                        size += len(parts[end])
                        end += 1
                    s, m = measured(parts[at:end], shared.value, fold[at:end])
                    np.add.at(sums, owner[at:end], s)
                    np.maximum.at(most, owner[at:end], m)
                    at = end
                x = features(sums, most)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([one.column(0), lists], ["_row", "features"])

    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {kind}, features array<double>")


def _counted(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
    """``(entry, fold, n)``: in how many texts of each fold an entry stands, of all entries or those of ``only``."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20):
                one = batch.slice(a, b - a)
                parts, owner = stretches(one.column(0).to_pylist())
                fold = one.column(1).to_numpy(zero_copy_only=False)
                found = []
                for n in range(len(parts)):
                    s = Signs([parts[n]])
                    own = np.unique(np.concatenate([h for _, h in entries(s.codes, s.start, s.stop)]))
                    own = own if shared.value is None else np.intersect1d(own, shared.value, assume_unique=True)
                    if n and owner[n] == owner[n - 1]:
                        own = np.setdiff1d(own, found[-1][1], assume_unique=True)
                        own = np.concatenate([found.pop()[1], own])
                    found.append((fold[owner[n]], np.sort(own)))
                for f in range(FOLDS):
                    some = [x for g, x in found if g == f]
                    if some:
                        keys, n = np.unique(np.concatenate(some), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), f, np.int32)), pa.array(n.astype(np.int64))], ["entry", "fold", "n"])

    return rows.select("_text", "_fold").mapInArrow(run, "entry long, fold int, n long").groupBy("entry", "fold").agg(F.sum("n").alias("n"))


def _by_fold(counts: DataFrame) -> DataFrame:
    return counts.groupBy("entry").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in range(FOLDS)])


def learn_lexicon(rows: DataFrame, entries_kept: int = ENTRIES) -> Lexicon:
    """From ``rows(_text, _fold, _label)``: entries of which the lower bound of the log odds for a toxic text is positive,
    for each fold left out, and for none. They must stand in toxic texts of two folds, as copies share a fold."""
    of = {(r["_label"], r["_fold"]): r["n"] for r in rows.groupBy("_label", "_fold").agg(F.count("*").alias("n")).collect()}
    total = np.array([[of.get((y, f), 0) for f in range(FOLDS)] for y in (0, 1)], float)
    toxic = _by_fold(_counted(rows.where("_label = 1"), None))
    folds, times = sum((F.col(f"n{f}") > 0).cast("int") for f in range(FOLDS)), sum(F.col(f"n{f}") for f in range(FOLDS))
    got = toxic.where(folds > 1).orderBy(times.desc(), "entry").limit(entries_kept).toPandas().to_numpy(np.int64)
    got = got[np.argsort(got[:, 0].view(np.uint64), kind="stable")] if len(got) else np.zeros((0, FOLDS + 1), np.int64)
    keys, ones = np.ascontiguousarray(got[:, 0]).view(np.uint64), got[:, 1:].astype(float)
    zeros = np.zeros_like(ones)
    if len(keys):
        seen = _counted(rows.where("_label = 0"), keys).toPandas()
        zeros[np.searchsorted(keys, seen["entry"].to_numpy(np.int64).view(np.uint64)), seen["fold"].to_numpy()] = seen["n"]
    weight = np.zeros((len(keys), FOLDS + 1), np.float32)
    for out in range(FOLDS + 1):
        used = np.arange(FOLDS) != out
        n1, n0, (all0, all1) = ones[:, used].sum(1) + 0.5, zeros[:, used].sum(1) + 0.5, total[:, used].sum(1) + 1
        bound = np.log(n1 / all1) - np.log(n0 / all0) - 1.28 * np.sqrt(1 / n1 + 1 / n0)
        weight[:, out] = np.where((ones[:, used] > 0).sum(1) > 1, np.maximum(bound, 0), 0)
    kept = weight.any(axis=1)
    return Lexicon(keys[kept], weight[kept])


@dataclass
class Model:
    """A constant ``share`` where nothing could be learned, else the lexicon, the trees and the calibration."""

    share: float
    lexicon: Lexicon | None = None
    trees: GBTClassificationModel | None = None
    scale: IsotonicRegressionModel | None = None


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 200_000, rounds: int = 30, depth: int = 3, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` has a label for: at most about ``most_rows``, by a hash of their id; a
    document with several labels is toxic if one says so, null labels and ids say nothing. Folds go by a hash of the text, so
    copies share one. The trees see features by the lexicon of the other folds; the calibration sees rows the trees have not.
    Where all labels are the same, or one part has one kind of label only, every score is the share of toxic labels (none: 0).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) / F.lit(1e6)
    share = min(1.0, most_rows / max(1, known.count()))
    chosen = known.where(place < share)  # about most_rows rows of 12 bytes
    text_of = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), text_of.alias("_text")).join(F.broadcast(chosen), "_id")
    fold = F.pmod(F.xxhash64("_text", F.lit("fold")), F.lit(FOLDS)).cast("int")
    rows = cut(rows.select("_text", fold.alias("_fold"), "_label"), "labelled")
    seen = {(r["part"], r["_label"]): r["n"] for r in rows.groupBy((F.col("_fold") < TREES).alias("part"), "_label").agg(F.count("*").alias("n")).collect()}
    ones = sum(n for (_, y), n in seen.items() if y == 1)
    model = Model(ones / max(1, sum(seen.values())))
    if len(seen) == 4:
        model.lexicon = learn_lexicon(rows)
        given = rows.select(F.struct("_fold", "_label").alias("_row"), "_text", "_fold")
        made = cut(with_features(given, model.lexicon), "features")
        made = made.select(F.col("_row._fold").alias("fold"), F.col("_row._label").cast("double").alias("label"), array_to_vector("features").alias("features"))
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, minInstancesPerNode=3, seed=1, maxMemoryInMB=64)
        model.trees = trees.fit(made.where(F.col("fold") < TREES))
        sure = model.trees.transform(made.where(F.col("fold") >= TREES)).select("label", vector_to_array("probability")[1].alias("sure"))
        model.scale = IsotonicRegression(featuresCol="sure").fit(sure)
    drop_cut(rows)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (``["doc_id"]`` unless given) of every row with ``score double``, the share of toxic texts among
    training rows like it, from 0 to 1. Texts are read whole, null counts as empty; repeated rows stay; an empty table gives
    no rows. No shuffle."""
    keep = ["doc_id"] if keep is None else keep
    if model.trees is None:
        return docs.select(*keep, F.lit(float(model.share)).alias("score"))
    rows = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.lit(FOLDS).alias("_fold"))
    made = with_features(rows, model.lexicon).withColumn("features", array_to_vector("features"))
    sure = model.trees.transform(made).select("_row", vector_to_array("probability")[1].alias("sure"))
    done = model.scale.transform(sure)
    return done.select("_row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction"))).alias("score"))
