"""Benchmark decontamination by latent semantic retrieval.

A randomised SVD of TF-IDF passages of all documents gives a latent space; windows of every document are projected into
it and compared with the benchmark's passages by cosine. What comes near is checked word by word: the longest common
subsequence with the item, and its answer (the last sentence) for paraphrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, drop_cut, row_ids
from .tokens import CodeWords

#: Half a window, in words; windows overlap by half.
HALF = 32
#: A block of the benchmark, whose vectors are held at once, ends with the item that reaches either; more blocks take
#: more passes.
BLOCK_ITEMS, BLOCK_WORDS = 8192, 500_000
RANK, OVERSAMPLE = 128, 16
#: Halves whose vectors are summed at once.
STEP = 1024


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each text: runs of letters, numbers and underscores in lower case."""
    words = CodeWords(texts, "word")
    return np.split(words.hashes(), np.cumsum(words.counts)[:-1]) if texts else []


def masks(b: list) -> dict:
    """The places of each word of ``b`` as the bits of one integer."""
    mask: dict = {}
    for i, x in enumerate(b):
        mask[x] = mask.get(x, 0) | 1 << i
    return mask


def lcs(a: list, mask: dict, size: int, least: float = 0.0) -> int:
    """Length of the longest common subsequence of ``a`` and the ``size`` words behind ``mask``, one big-integer step
    per common word; 0 if fewer than ``least`` words are common, as it cannot be longer than that."""
    hits = [m for x in a if (m := mask.get(x))]
    if len(hits) < least:
        return 0
    full = s = (1 << size) - 1
    for m in hits:
        u = s & m
        s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def answer_of(text: str) -> str:
    """The last sentence that has a word."""
    for part in reversed(re.split(r"[.!?\n]+", text)):
        if re.search(r"\w", part):
            return part
    return ""


@dataclass
class Space:
    """Each vocabulary word's weight and weighted place in the latent space, and the benchmark's passages there."""

    weight: np.ndarray
    embed: np.ndarray
    owner: np.ndarray
    unit: np.ndarray
    least: np.ndarray
    items: list[tuple[int, list[int], list[int]]]


def numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted vocabulary, -1 where it is not there."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1).astype(np.int32)


def word_numbers(docs: DataFrame, vocabulary: np.ndarray, id_column: str, text: str) -> DataFrame:
    """``(_id, row_id, ids array<int>)``: every word of every whole text by its place in the vocabulary, others -1."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                part = batch.slice(a, b - a)
                words = CodeWords(part.column(2).to_pylist(), "word")
                ends = np.concatenate([[0], np.cumsum(words.counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbered(words.hashes(), shared.value)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["_id", "row_id", "ids"])

    source = docs.select(F.col(id_column).alias("_id"), "row_id", F.col(text).alias("_text"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, row_id long, ids array<int>")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts


def halves(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known words of half windows: (word ids, start of each half among them, document of each half, its number there)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    number = (np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)) // HALF
    at = np.flatnonzero(ids >= 0)
    some, doc, number = ids[at], doc[at], number[at]
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])) if len(at) else at
    return some, start, doc[start], number[start]


def half_sums(vectors: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sum of the vectors of the words of each half."""
    out = np.empty((len(start), vectors.shape[1]), np.float32)
    ends = np.append(start[1:], len(ids))
    for a in range(0, len(start), STEP):
        lo, hi = start[a], ends[min(a + STEP, len(start)) - 1]
        out[a : a + STEP] = np.add.reduceat(vectors[ids[lo:hi]], start[a : a + STEP] - lo, axis=0)
    return out


def document_frequency(numbers: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, over all documents, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            ids, counts = flat(batch.column(0))
            doc = np.repeat(np.arange(len(counts)), counts)
            known = ids >= 0
            total[:-1] += np.bincount(np.unique(doc[known] * size + ids[known]) % size, minlength=size)
            total[-1] += len(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["word", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in numbers.select("ids").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["word"]] = r["n"]
    return out[:-1], int(out[-1])


def spread(ids: np.ndarray, start: np.ndarray, weighted: np.ndarray, total: np.ndarray) -> float:
    """Add A'(A Z) of some halves to ``total``, where ``weighted`` is Z times the weights of the words (the weights on
    the left come last); returns the squared length of A Z."""
    ends, energy = np.append(start[1:], len(ids)), 0.0
    for a in range(0, len(start), STEP):
        lo, hi = start[a], ends[min(a + STEP, len(start)) - 1]
        y = half_sums(weighted, ids[lo:hi], start[a : a + STEP] - lo)
        energy += float(np.einsum("ij,ij->", y, y))
        owner = np.repeat(np.arange(len(y)), np.diff(np.append(start[a : a + STEP], hi)))
        order = np.argsort(ids[lo:hi], kind="stable")
        word = ids[lo:hi][order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total[word[first]] += np.add.reduceat(y[owner[order]], first, axis=0)
    return energy


def randomised_svd(numbers: DataFrame, weight: np.ndarray, own: tuple[np.ndarray, np.ndarray], rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF passages of all documents and of the benchmark (``own``), in
    one pass: from A'(A Z) of a random Z, by the method of Nystroem.

    Tasks sum what they read; their sums are added up on the executors, one matrix at a time, before a few reach the
    driver. The benchmark's passages are scaled to carry as much as all documents together, so that its rare words
    have a say.
    """
    z = np.random.default_rng(seed).standard_normal((len(weight), rank + OVERSAMPLE)).astype(np.float32)
    weighted = z * weight[:, None]
    session = numbers.sparkSession
    shared = session.sparkContext.broadcast(weighted)  # bounded by BLOCK_WORDS and the rank

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, energy = np.zeros(shared.value.shape, np.float64), 0.0
        for batch in batches:
            ids, start, _, _ = halves(*flat(batch.column(0)))
            if len(start):
                energy += spread(ids, start, shared.value, total)
        if energy:
            yield pa.RecordBatch.from_pydict({"m": [total.tobytes()], "e": [energy]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, energy = None, 0.0
        for batch in batches:
            for m, e in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(m.as_py(), np.float64)
                total = x.copy() if total is None else total + x
                energy += e
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": [total.tobytes()], "e": [energy]})

    few = max(1, int(int(session.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    sums = numbers.select("ids").mapInArrow(part, "m binary, e double").repartition(few).mapInArrow(add, "m binary, e double")
    total, energy = np.zeros(z.shape, np.float64), 0.0
    for r in sums.toLocalIterator():
        total += np.frombuffer(r["m"], np.float64).reshape(z.shape)
        energy += r["e"]
    shared.unpersist()
    ours = np.zeros(z.shape, np.float64)
    scale = energy / max(spread(*own, weighted, ours), 1e-30) if energy else 1.0
    y = (total + ours * scale) * weight[:, None]
    inner = z.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > values.max(initial=0.0) * 1e-9
    if not good.any():
        return np.eye(len(weight), rank, dtype=np.float32)
    u, _, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return u[:, :rank].astype(np.float32)


def fit(docs: DataFrame, items: list[tuple[int, str]], id_column: str, text: str) -> tuple[Space, DataFrame]:
    """The latent space of one block of items, by frequencies and an SVD over all documents, and the numbered words of
    the documents."""
    told = words_of([t for _, t in items])
    vocabulary = np.unique(np.concatenate(told))
    numbers = cut(word_numbers(docs, vocabulary, id_column, text), "numbers")
    seen, total = document_frequency(numbers, len(vocabulary))
    # Every word keeps a weight, so items of common words only have a direction too.
    weight = (np.log((total + 1) / (seen + 1)) + 0.05).astype(np.float32)
    words = [numbered(h, vocabulary) for h in told]
    owner, ids, start, at = [], [], [], 0
    for n, w in enumerate(words):
        for a in range(0, max(1, len(w) - HALF), HALF):
            some = w[a : a + 2 * HALF]
            owner.append(n)
            ids.append(some)
            start.append(at)
            at += len(some)
    flat_ids, begin = np.concatenate(ids), np.array(start)
    basis = randomised_svd(numbers, weight, (flat_ids, begin), max(1, min(RANK, len(vocabulary))))
    embed = basis * weight[:, None]
    latent = half_sums(embed, flat_ids, begin)
    norm = np.linalg.norm(latent, axis=1)
    answers = [numbered(h, vocabulary).tolist() for h in words_of([answer_of(t) for _, t in items])]
    return Space(weight, embed, np.array(owner), latent / np.maximum(norm, 1e-9)[:, None], norm, [(i, w.tolist(), x) for (i, _), w, x in zip(items, words, answers, strict=True)]), numbers


def matches(numbers: DataFrame, space: Space, cosine: float, share: float, ratio: float) -> DataFrame:
    shared = numbers.sparkSession.sparkContext.broadcast(space)  # bounded by BLOCK_ITEMS, BLOCK_WORDS and the rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        bits = [(masks(ws), masks(answer)) for _, ws, answer in s.items]

        def held(words: list[int], near: list[int]) -> float:
            """The share of the weight of some words that stands near, in any order."""
            own = np.unique(words)
            return float(s.weight[own[np.isin(own, near)]].sum() / s.weight[own].sum())

        floor = min(ratio, 0.5)
        for batch in batches:
            out: dict[tuple[int, int], tuple[float, float, float]] = {}
            ids, counts = flat(batch.column(2))
            begin = np.cumsum(counts) - counts
            some, start, owner, first = halves(ids, counts)
            for b in range(0, len(start), 8192):
                # A window is a half and the next one, if that follows directly.
                e = min(b + 8193, len(start))
                stop = start[e] if e < len(start) else len(some)
                vectors = half_sums(s.embed, some[start[b] : stop], start[b:e] - start[b])
                joins = np.flatnonzero((owner[b + 1 : e] == owner[b : e - 1]) & (first[b + 1 : e] == first[b : e - 1] + 1))
                window = vectors[: min(8192, e - b)].copy()
                window[joins] += vectors[joins + 1]
                norm = np.maximum(np.linalg.norm(window, axis=1), 1e-9)
                dot = window @ s.unit.T
                w, p = np.nonzero((dot >= cosine * norm[:, None]) & (dot >= share * s.least[None, :]))
                for i, j in zip(w.tolist(), p.tolist(), strict=True):
                    n, d = int(s.owner[j]), int(owner[b + i])
                    item, ws, answer = s.items[n]
                    middle, reach = int(first[b + i]) * HALF, max(len(ws), HALF)
                    near = ids[begin[d] + max(0, middle - reach) : begin[d] + min(int(counts[d]), middle + 2 * HALF + reach)].tolist()
                    r = lcs(near, bits[n][0], len(ws), floor * len(ws) - 1e-9) / len(ws)
                    if r < floor:
                        continue
                    told = lcs(near, bits[n][1], len(answer)) / len(answer) if answer else 0.0
                    # Common words alone meet by chance, so half of an item must hold half of its weight too.
                    if r >= ratio or (len(answer) >= 4 and told >= 0.9 and held(ws, near) >= 0.5):
                        out[d, n] = max(out.get((d, n), (0.0, 0.0, 0.0)), (r, told, float(dot[i, j] / norm[i])))
            keys = sorted(out)
            place = batch.take(pa.array([k[0] for k in keys], pa.int64()))
            yield pa.RecordBatch.from_arrays([place.column(0), place.column(1), pa.array([s.items[k[1]][0] for k in keys], pa.int64()), *[pa.array([out[k][c] for k in keys], pa.float64()) for c in (2, 0, 1)]], ["_id", "row_id", "item_id", "cosine", "lcs_ratio", "answer_ratio"])

    return numbers.mapInArrow(run, f"_id {numbers.schema['_id'].dataType.simpleString()}, row_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double")


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, share: float = 0.4, ratio: float = 0.7, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows ``(row_id, <id>, item_id, cosine, lcs_ratio, answer_ratio)``: documents that hold an item of the benchmark.

    A window is a candidate if its cosine with a passage of the item reaches ``cosine`` and it holds ``share`` of that
    passage's latent length. It is a leak if the longest common subsequence covers ``ratio`` of the item's words, or
    half of them and nine tenths of an answer of four words or more while half of the item's weight (inverse document
    frequency) stands there. Null and empty texts and items, and items without
    an id, match nothing; repeated items each match, repeated rows each match; without items or documents there are no
    rows. Only the benchmark is read by the driver, in blocks; documents are never shuffled.
    """
    if "row_id" not in docs.columns:
        docs = row_ids(docs.select(id_column, text), id_column, text)
    named = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    found = []
    block: list[tuple[int, str]] = []
    words = 0

    def solve() -> None:
        nonlocal block, words
        if block:
            space, numbers = fit(docs, block, id_column, text)
            found.append(cut(matches(numbers, space, cosine, share, ratio), "leaks"))
            drop_cut(numbers)
        block, words = [], 0

    for r in named.orderBy("i", "t").toLocalIterator():
        if n := int(CodeWords([r["t"]], "word").counts.sum()):
            block.append((r["i"], r["t"]))
            words += n
        if len(block) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            solve()
    solve()
    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"_id {kind}, row_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double") if not found else found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.withColumnRenamed("_id", id_column)
