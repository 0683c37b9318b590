"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import components, cut, drop_cut, row_ids, sieve, sieve_words

SEED = 42


def shingle_hashes(text: str, words: int, out: list[int]) -> int:
    """Append the XXH64 of each shingle of ``words`` words; returns how many."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return 0
    data = b" ".join(found)
    length = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    k = min(words, n)
    digest = xxhash.xxh64_intdigest
    out += [digest(data[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return n - k + 1


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    hashes: list[int] = []
    counts = np.array([shingle_hashes(t, words, hashes) for t in texts], np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        flat = np.array(hashes, "<u8")
        starts = (np.cumsum(counts) - counts)[full]
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        over = (2 * ones > counts[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The 64-bit SimHash of every whole text as ``fp long``, beside the columns ``keep`` (``["doc_id"]`` unless given).

    A-Z is lower-cased; words are runs without ASCII white space; shingles of ``words`` words, repeats included. A text
    with fewer words is one shingle; a null text or one without words has fingerprint zero. No shuffle.
    """
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(keep)), 1 << 20):
                part = batch.slice(a, b - a)
                fp = fingerprints_of([t or "" for t in part.column(len(keep)).to_pylist()], words)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(fp.view(np.int64))], [*keep, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{fields}{', ' if keep else ''}fp long")


def block_keys(distance: int, blocks: int) -> list[tuple[int, ...]]:
    """Masks: every pair within ``distance`` bits agrees on at least ``blocks - distance`` of the blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [sum(part[i] for i in c) for c in combinations(range(blocks), blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def close_pairs(prints: DataFrame, distance: int = 2, blocks: int = 5) -> DataFrame:
    """Pairs ``(a long, b long)``, a < b, of distinct values of ``fp`` that differ in 1 to ``distance`` bits.

    With five blocks and two differing bits at least three blocks agree, so the join key has 38 bits or more: buckets
    stay short however large the corpus. The Hamming check is part of the join condition.
    """
    masks = [_signed(m) for m in block_keys(distance, blocks)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])
    side = prints.select("fp").distinct().select("fp", F.explode(keys).alias("k"))
    left = side.select(F.col("k.i").alias("i"), F.col("k.v").alias("v"), F.col("fp").alias("a"))
    right = side.select(F.col("k.i").alias("j"), F.col("k.v").alias("w"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, (F.col("i") == F.col("j")) & (F.col("v") == F.col("w")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its id, ``fp long`` and ``component_id``, the smallest id reachable over links.

    Equal fingerprints are one node, so copies never expand into pairs; links between nodes come from
    ``close_pairs`` and are joined by star rounds. Rows without an id keep their fingerprint and take part as links;
    their component is the smallest id there, null if there is none. Repeated rows stay; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, words, text, [id_column]).withColumnRenamed(id_column, "_id"), "prints")
    nodes = prints.groupBy("fp").agg(F.min("_id").alias("low"))
    linked = components(close_pairs(nodes, distance, blocks))
    classes = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "low")
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.select("fp", "component").join(lows, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("_id").alias(id_column), "fp", "component_id")


#: Buckets of the sketch of shingle frequencies.
SKETCH = 1 << 18


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """Some rows ``(row_id, _text)`` at a time: ids, the distinct shingle hashes of each text in order, their SimHashes."""
    for batch in batches:
        for a, b in slices(batch.column(1), 1 << 18):
            part = batch.slice(a, b - a)
            sets, prints = [], np.zeros(b - a, np.uint64)
            for i, t in enumerate(part.column(1).to_pylist()):
                hashes: list[int] = []
                shingle_hashes(t or "", words, hashes)
                h = np.array(hashes, np.uint64)
                sets.append(np.unique(h))
                prints[i] = _majority(h)
            yield part.column(0).to_numpy(), sets, prints


def _majority(h: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 12):
        ones += np.unpackbits(h[a : a + (1 << 12)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0]


def _node(h: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def set_prints(rows: DataFrame, words: int) -> DataFrame:
    """``(row_id, node long, n int, fp long)``: a hash of the set of distinct shingles of every ``_text``, its size, and the
    SimHash. The sets are eight bytes a word, more than the text: they are not kept, but made again where they are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, prints in _sets(batches, words):
            columns = [pa.array(ids), pa.array([_node(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "node", "n", "fp"])

    return rows.select("row_id", "_text").mapInArrow(run, "row_id long, node long, n int, fp long")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """``(node long, n int, h array<long>)``: the distinct shingle hashes of every ``_text`` and a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, _ in _sets(batches, words):
            size = np.array([len(x) for x in sets], np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), pa.array(size), lists], ["node", "n", "h"])

    return rows.select("row_id", "_text").mapInArrow(run, "node long, n int, h array<long>")


def common_buckets(rows: DataFrame, words: int) -> np.ndarray:
    """About how often the shingles of each bucket occur. Each task tells only what stands out: the counts give an order,
    and any order leads to the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for _, sets, _ in _sets(batches, words):
            for h in sets:
                np.add.at(total, (h % np.uint64(SKETCH)).astype(np.int64), 1)
        some = np.flatnonzero(total > 1 + 2 * total.mean())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(SKETCH, np.int64)
    for r in rows.select("row_id", "_text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def prefix_rows(rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """``(k long, node long, n int)``: the rarest shingles of every set, so many that sets of the similarity share one."""
    shared = rows.sparkSession.sparkContext.broadcast(common_buckets(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for _, sets, _ in _sets(batches, words):
            some = []
            for h in sets:
                first = len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1 if len(h) else 0
                some.append(h[np.argsort(often[(h % np.uint64(SKETCH)).astype(np.int64)], kind="stable")[:first]])
            many = [len(x) for x in some]
            node, size = (np.repeat(np.array([f(h) for h in sets], t), many) for f, t in ((_node, np.int64), (len, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *some]).view(np.int64)), pa.array(node), pa.array(size)], ["k", "node", "n"])

    return rows.select("row_id", "_text").mapInArrow(run, "k long, node long, n int")


def parity_bits(rows: DataFrame, words: int) -> DataFrame:
    """``(node, n, bits binary)`` of the sets: for each of 2 to 4 places an element, whether an odd number of
    elements falls there. A quarter of a byte or two an element, where the set itself has eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, _ in _sets(batches, words):
            made = []
            for h in sets:
                places = 1 << max(6, (2 * len(h) - 1).bit_length())
                made.append(np.packbits(np.bincount((h % np.uint64(places)).astype(np.int64), minlength=places) & 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([_node(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array(made, pa.binary())], ["node", "n", "bits"])

    return rows.select("row_id", "_text").mapInArrow(run, "node long, n int, bits binary")


def within_reach(pairs: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)`` of ``pairs(a, m, g, b, n, bits)`` that may reach the similarity.

    Each element that only one set has turns one place, so the sets differ in at least as many elements as the bits in
    places; that bounds what they share from above. No pair that reaches the similarity is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, g, n, bits in zip(*[batch.column(i).to_pylist() for i in (1, 2, 4, 5)], strict=True):
                x, y = np.frombuffer(g, np.uint8), np.frombuffer(bits, np.uint8)
                while len(x) != len(y):
                    if len(x) < len(y):
                        x, y = y, x
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                apart = int(np.bitwise_count(x ^ y).sum())
                keep.append((n + m - apart) / 2 >= threshold / (1 + threshold) * (n + m) - 1e-9)
            some = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(3).filter(some)], ["a", "b"])

    return pairs.select("a", "m", "g", "b", "n", "bits").mapInArrow(run, "a long, b long")


def same_prints(named: DataFrame) -> DataFrame:
    """Candidates ``(a, n, b, m)`` by SimHash: sets of one fingerprint with the smallest node of it, and the smallest nodes
    of fingerprints that differ in at most two bits."""
    first = named.groupBy("fp").agg(F.min("node").alias("b"))
    sizes = named.select(F.col("node").alias("b"), F.col("n").alias("m"))
    alike = named.join(first, "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    close = close_pairs(named).join(first.select(F.col("fp").alias("a"), F.col("b").alias("one")), "a").join(first.select(F.col("fp").alias("b"), F.col("b").alias("two")), "b")
    both = alike.union(close.select(F.col("one").alias("a"), F.col("two").alias("b")))
    return both.join(named.select(F.col("node").alias("a"), "n"), "a").join(sizes, "b").select("a", "n", "b", "m")


def similar_sets(rows: DataFrame, prints: DataFrame, words: int, threshold: float) -> DataFrame:
    """``(node long, component long)`` over all pairs of distinct shingle sets of ``rows(row_id, _text)`` whose Jaccard
    similarity reaches ``threshold``; ``prints`` are their ``set_prints``.

    Pairs of close SimHashes are verified first and give components. As no distance of 64 bits guarantees a similarity,
    the rest is found exactly: similar sets share one of their rarest shingles (prefix filter). Each set meets the
    smallest node of each shingle; then, where a shingle still joins several components, the sets outside the largest
    one meet the others of it. Copies and large groups of near copies so never expand into all pairs, and sets of one
    component never meet again. Parity bits rule out most pairs that are not similar before a whole set is moved; those
    left are verified on the whole sets. Unrelated sets of similar size that share one of their rarest shingles do meet
    in pairs of bits.
    """
    named = cut(prints.where("n > 0").groupBy("node").agg(F.min("row_id").alias("row_id"), F.min("n").alias("n"), F.min("fp").alias("fp")), "named")
    fits = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = cut(pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        bits = cut(parity_bits(held(pairs), words).dropDuplicates(["node"]), "bits")
        near = pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("g")), "a").join(bits.withColumnRenamed("node", "b"), "b")
        near = cut(within_reach(near, threshold), "near")
        drop_cut(pairs)
        drop_cut(bits)
        whole = shingle_sets(held(near), words).dropDuplicates(["node"])
        left = whole.select(F.col("node").alias("a"), F.col("h").alias("g"), F.col("n").alias("m"))
        both = near.join(left, "a").join(whole.withColumnRenamed("node", "b"), "b")
        same = F.size(F.array_intersect("g", "h"))
        out = cut(both.where(same >= threshold * (F.col("n") + F.col("m") - same) - 1e-9).select("a", "b"), name)
        drop_cut(near)
        return out

    def held(pairs: DataFrame) -> DataFrame:
        """The text of one row of each set that a pair names, and a few more texts. None is moved."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        some = cut(sieve(named, "node", wanted).join(wanted, "node").select("row_id"), "wanted")
        return sieve(rows, "row_id", some, words=sieve_words(some))

    found = links(same_prints(named), "close")
    linked = cut(components(found), "linked")
    keys = cut(prefix_rows(rows, words, threshold), "keys")
    centres = cut(keys.groupBy("k").agg(F.min("node").alias("c"), F.max("node").alias("top")).where("c <> top").select("k", "c"), "centres")
    met = cut(sieve(keys, "k", centres, words=sieve_words(centres)).join(centres, "k").select("k", "node", "n", "c").distinct(), "met")
    drop_cut(keys)
    drop_cut(centres)
    star = met.where("node <> c").select(F.col("node").alias("a"), "n", F.col("c").alias("b")).distinct()
    star = star.join(linked.select(F.col("node").alias("a"), F.col("component").alias("one")), "a", "left").join(linked.select(F.col("node").alias("b"), F.col("component").alias("two")), "b", "left")
    star = star.where("one is null or two is null or one <> two").join(named.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
    found = found.union(links(star.select("a", "n", "b", "m"), "star"))
    drop_cut(linked)
    linked = cut(components(found), "linked")
    told = cut(met.join(linked, "node", "left").select("k", "node", "n", F.coalesce("component", "node").alias("component")), "told")
    drop_cut(met)
    parts = told.groupBy("k", "component").agg(F.count("*").alias("many")).groupBy("k").agg(F.max_by("component", "many").alias("large"), F.count("*").alias("parts"))
    mixed = cut(parts.where("parts > 1").select("k", "large"), "mixed")
    outside = told.join(mixed, "k").where("component <> large").select("k", F.col("node").alias("a"), "n", F.col("component").alias("one"))
    others = told.join(mixed, "k", "left_semi").select("k", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("two"))
    more = links(outside.join(others, "k").where("one <> two"), "more")
    drop_cut(told)
    return linked if more.isEmpty() else components(found.union(more))


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: the smallest id (null first), then the smallest hash of
    the text.

    Texts are near copies if the Jaccard similarity of their sets of ``words``-word shingles reaches ``threshold``;
    groups are the connected components. Close SimHashes are looked at first, a prefix filter finds the rest. Texts
    without words are copies of each other; rows that repeat both id and text count as copies, so one of them stays.
    """
    rows = row_ids(docs, id_column, text)
    texts = rows.select("row_id", F.col(text).alias("_text"))
    prints = cut(set_prints(texts, words), "prints")
    linked = similar_sets(texts, prints, words, threshold)
    ids = rows.select(F.col(id_column).alias("i"), "row_id").distinct()
    named = prints.select("row_id", "node").distinct().join(linked, "node", "left").join(ids, "row_id").select("row_id", F.struct("i", F.col("row_id").alias("r")).alias("_key"), F.coalesce("component", "node").alias("component"))
    stay = cut(named.groupBy("component").agg(F.min("_key").alias("_key")).select("_key.r").withColumnRenamed("r", "row_id"), "stay")
    kept = sieve(rows, "row_id", stay).join(stay, "row_id", "left_semi")
    often = kept.groupBy("row_id").count().where("count > 1").select("row_id")
    if not often.isEmpty():
        kept = kept.join(often, "row_id", "left_anti").union(kept.join(often, "row_id", "left_semi").dropDuplicates(["row_id"]))
    return kept.select(*docs.columns)
