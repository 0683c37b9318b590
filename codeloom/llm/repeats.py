"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash triggers phrase boundaries: the trigger of a window of W positions is its smallest k-gram hash, so equal
windows have the same trigger at the same place. A phrase holds the strings of ``length`` bytes whose first W positions
have its trigger. Distinct phrases are the dictionary; one that repeats as a whole is settled as a whole.

The others are put in corpus order where they share the bytes after their trigger. A string is a suffix of the phrase's
head (the bytes before the trigger) and then the text from the trigger on, its parse suffix. Heads, read from the
trigger to the left, are sorted as the suffixes of the dictionary, parse suffixes are sorted as the suffix array of the
parse, both with the common prefixes of neighbours taken on bytes. For each length of the head part the two orders cut
into classes, and the pair of classes is the place of a string in the corpus order: strings with one pair are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, drop_cut, row_ids, sieve
from .tokens import Rolled, mix, raw_texts

GRAM = 16
#: Distinct phrases of one context from which their strings are dealt by value instead of by context.
HOT = 50_000
BATCH_BYTES = 8 << 20
#: Bits of a gram's hash that order it; the rest hold its place, so equal windows choose alike in every batch.
PLACE_BITS = np.uint64(32)


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (of equal ones the first) of every ``width`` neighbours, by block prefix and suffix
    minima."""
    n, bits = len(hashes), PLACE_BITS
    keys = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(right[:count], left[width - 1 : width - 1 + count]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def phrases_of(texts: list[bytes], length: int) -> dict[str, np.ndarray] | None:
    """Phrases of some documents: number of the document, first and last start of their strings, place of the trigger
    (all within the document), ``k1`` of the bytes that all of its strings hold after it, ``k2`` of all its bytes."""
    width = length - GRAM - length // 8
    sizes = np.array([len(t) for t in texts])
    if not len(sizes) or sizes.max() < length:
        return None
    data = np.frombuffer(b"".join(texts), np.uint8)
    rolled = Rolled(data)
    at = np.arange(len(data) - GRAM + 1)
    trigger = sliding_argmin(rolled.of(at, at + GRAM), width)
    begin = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - length + 1, 0)
    starts = np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)
    doc = np.repeat(np.arange(len(texts)), many)
    own = trigger[starts]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, a, d = starts[first], starts[last], own[first], doc[first]
    shape = ((a - lo) * 1024 + (hi - lo)).astype(np.uint64)
    k1 = rolled.of(a, a + length - width + 1)
    k2 = mix(rolled.of(lo, hi + length) + mix(shape + np.uint64(1)))
    base = begin[d]
    return {"doc": d, "lo": lo - base, "hi": hi - base, "a": a - base, "k1": k1, "k2": k2}


def phrase_rows(rows: DataFrame, length: int) -> DataFrame:
    """``(k1 long, k2 long, row_id long, lo int, a int, hi int)`` of every phrase of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                found = phrases_of(raw_texts(part.column(1).to_pylist()), length)
                if found is not None:
                    row = part.column(0).to_numpy()[found["doc"]]
                    yield pa.RecordBatch.from_arrays([pa.array(found["k1"].view(np.int64)), pa.array(found["k2"].view(np.int64)), pa.array(row), *[pa.array(found[k].astype(np.int32)) for k in ("lo", "a", "hi")]], ["k1", "k2", "row_id", "lo", "a", "hi"])

    return rows.select("row_id", "_text").mapInArrow(run, "k1 long, k2 long, row_id long, lo int, a int, hi int")


def _sorted(flat: np.ndarray, at: np.ndarray, step: int, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the byte strings that run from ``at`` by ``step`` over ``size`` bytes, padded to ``width`` with zeros, and
    how many bytes each shares with the one before it in that order."""
    column = np.arange(width)
    inside = column[None, :] < size[:, None]
    cells = np.where(inside, flat[np.where(inside, at[:, None] + step * column[None, :], 0)], 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(cells).view(f"S{width}").ravel(), kind="stable")
    cells = cells[order]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        apart = np.ones((len(order) - 1, width + 1), bool)
        np.not_equal(cells[1:], cells[:-1], out=apart[:, :width])
        shared[1:] = apart.argmax(axis=1)
    return order, shared


def repeated_starts(data: list[bytes], before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of some phrases, each with ``before`` bytes ahead of its trigger: (phrase, offset) of every string of ``length``
    bytes that another phrase holds at the same place to its trigger."""
    none = np.zeros(0, np.int64)
    if len(data) < 2:
        return none, none
    n = len(data)
    size = np.fromiter(map(len, data), np.int64, n)
    flat = np.frombuffer(b"".join(data), np.uint8)
    trigger = np.cumsum(size) - size + before
    after = size - before
    heads, shared_head = _sorted(flat, trigger - 1, -1, before, max(1, int(before.max())))
    tails, shared_tail = _sorted(flat, trigger, 1, after, length)
    phrase, offset = [none], [none]
    head_class, tail_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(max(0, length - int(after.max())), int(before.max()) + 1):
        live = np.flatnonzero((before >= d) & (after >= length - d))
        if len(live) < 2:
            continue
        head_class[heads] = np.cumsum(shared_head < d)
        tail_class[tails] = np.cumsum(shared_tail < length - d)
        place = head_class[live] * (n + 1) + tail_class[live]
        order = np.argsort(place, kind="stable")
        same = place[order][1:] == place[order][:-1]
        hit = np.zeros(len(live), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        phrase.append(live[hit])
        offset.append(before[live[hit]] - d)
    return np.concatenate(phrase), np.concatenate(offset)


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of a row in one: (row, start, end of what they cover)."""
    if not len(row):
        return row, start, start
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last] + length


OPEN = "k1 long, row_id long, lo int, before int, single boolean, data binary, x binary"


def open_phrases(hits: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The bytes of the phrases that are still open, ``(k1, row_id, lo, before, single, data)``; strings of hot contexts
    come one by one, by a hash of 128 bits: ``(k1, row_id, lo, single, x)``. The texts are met once, after a sieve, each
    with the list of its own phrases, which its length bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("k1", pa.int64()), ("row_id", pa.int64()), ("lo", pa.int32()), ("before", pa.int32()), ("single", pa.bool_()), ("data", pa.binary()), ("x", pa.binary())])
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                made: list[tuple] = []
                for row, raw, told in zip(part.column(0).to_pylist(), raw_texts(part.column(1).to_pylist()), part.column(2).to_pylist(), strict=True):
                    for p in told:
                        data = raw[p["lo"] : p["hi"] + length]
                        if not p["hot"]:
                            made.append((p["k1"], row, p["lo"], p["a"] - p["lo"], p["single"], data, None))
                            continue
                        for o in range(len(data) - length + 1):
                            made.append((p["k1"], row, p["lo"] + o, None, p["single"], None, xxhash.xxh3_128_digest(data[o : o + length])))
                        if len(made) > 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                            made = []
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    lists = hits.groupBy("row_id").agg(F.collect_list(F.struct("k1", "lo", "a", "hi", "single", "hot")).alias("told"))
    near = sieve(rows.select("row_id", "_text"), "row_id", hits.select("row_id")).join(lists, "row_id")
    return near.select("row_id", "_text", "told").mapInArrow(run, OPEN)


def resolved(phrases: DataFrame, length: int) -> DataFrame:
    """Strings of single open phrases that another phrase of the same context holds too: ``(row_id, s, e)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            owner, offset = repeated_starts(t.column("data").to_pylist(), t.column("before").to_numpy().astype(np.int64), length)
            wanted = t.column("single").to_numpy()[owner]
            owner, offset = owner[wanted], offset[wanted]
            row, s, e = _runs(t.column("row_id").to_numpy()[owner], t.column("lo").to_numpy()[owner] + offset, length)
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["row_id", "s", "e"])

        held = None
        for batch in batches:
            if not len(batch):
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.nbytes >= BATCH_BYTES:
                k1 = held.column("k1").to_numpy()
                last = int(np.searchsorted(k1, k1[-1], "left"))
                if last:
                    yield solve(held.slice(0, last))
                    held = held.slice(last).combine_chunks()
        if held is not None and len(held):
            yield solve(held)

    dealt = phrases.where("x is null").select("k1", "row_id", "lo", "before", "single", "data").repartition("k1").sortWithinPartitions("k1")
    return dealt.mapInArrow(run, "row_id long, s int, e int")


def repeated_ranges(rows: DataFrame, length: int = 200) -> DataFrame:
    """``(row_id, s, e)``: byte ranges of every document that strings of ``length`` bytes starting elsewhere cover.

    Two whole phrases are equal if two hashes of 64 bits each are; strings of different phrases are compared on bytes,
    in contexts of more than ``HOT`` different phrases by hashes of 128 bits.
    """
    phrases = cut(phrase_rows(rows, length), "phrases")
    dictionary = phrases.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "lo", "a", "hi")).alias("p"))
    known = dictionary.withColumn("g", F.count("*").over(Window.partitionBy("k1")))
    hits = cut(known.where("n > 1 or g > 1").select("k1", "k2", "p.*", F.expr("n = 1").alias("single"), F.expr("g > 1").alias("open"), F.expr(f"g > {HOT}").alias("hot")), "dictionary")
    often = hits.where("not single").select("k1", "k2")
    full = sieve(phrases, "k2", often.select("k2")).join(often, ["k1", "k2"], "left_semi").select("row_id", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    full = cut(full, "full")
    drop_cut(phrases)
    opened = cut(open_phrases(hits.where("open").select("row_id", "k1", "lo", "a", "hi", "single", "hot"), rows, length), "open")
    strings = opened.where("x is not null").select("x", "row_id", "lo", "single")
    again = strings.groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
    hot = strings.where("single").join(again, "x", "left_semi").select("row_id", F.col("lo").alias("s"), (F.col("lo") + length).alias("e"))
    return full.union(resolved(opened, length)).union(hot)


def remove_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_removed``, ``n_spans long``, ``kept binary`` (what is left) and
    ``removed array<struct<s int, e int>>`` (byte ranges).

    Every byte that a string of ``length`` bytes covers goes if the string also starts anywhere else, in this document
    or another; strings never cross documents and are judged on the input. Null texts count as empty; rows that repeat
    id and text repeat each other's strings; an empty table gives no rows.
    """
    keyed = row_ids(docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias("_text")), id_column, "_text")
    ranges = cut(repeated_ranges(keyed.select("row_id", "_text"), length), "ranges")
    lists = ranges.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("all"))
    clean = sieve(keyed, "row_id", ranges.select("row_id"), rest=True)
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    zero = F.lit(0).cast("long")
    untouched = clean.select(F.col(id_column).alias("_id"), F.octet_length("_text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("_text", "utf-8").alias("kept"), none.alias("removed"))
    met = sieve(keyed, "row_id", ranges.select("row_id")).join(lists, "row_id", "left").select(F.col(id_column).alias("_id"), "_text", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                sizes, gone, kept, spans = [], [], [], []
                for t, ranges_ in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for x in ranges_ or ():
                        if merged and x["s"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], x["e"])
                        else:
                            merged.append([x["s"], x["e"]])
                    cuts = [0, *[p for m in merged for p in m], len(raw)]
                    left = b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))
                    sizes.append(len(raw))
                    gone.append(len(raw) - len(left))
                    kept.append(left)
                    spans.append([{"s": s, "e": e} for s, e in merged])
                counts = pa.array([len(s) for s in spans], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), counts, pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    kind = met.schema["_id"].dataType.simpleString()
    touched = met.mapInArrow(run, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<s:int,e:int>>")
    return untouched.union(touched).withColumnRenamed("_id", id_column)
