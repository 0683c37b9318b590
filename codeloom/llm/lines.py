"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are ordered from rare to common; two lines of Jaccard similarity t share a word
among the first |x| - ceil(t |x|) + 1 of each. Entries of the same prefix word meet, and length, position and a parity
bitmap (a lower bound of the symmetric difference) leave few pairs to verify on the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import cut, drop_cut, row_ids, sieve
from .tokens import Words

#: Counters of word rarity: a fixed size, whatever the vocabulary.
RARITY_BITS = 20
#: Candidates a line names per prefix word before the exact second round takes over.
NAMED = 8
GROUP_ROWS = 200_000


def words_of_line(line: str) -> set[bytes]:
    return set(line.encode("utf-8", "surrogatepass").lower().split())


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often words of each hash bucket occur in all texts, as a level: 0 for once or never, then four levels for
    each doubling; one byte a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                total += np.bincount(_bucket(Words(batch.column(0).slice(a, b - a).to_pylist()).hash), minlength=1 << RARITY_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    out = np.zeros(1 << RARITY_BITS, np.uint8)
    for r in counted.select("bucket", F.least(F.lit(127), 1 + F.floor(4 * F.log2("n"))).alias("level")).toLocalIterator():  # at most 2 ** RARITY_BITS rows
        out[r["bucket"]] = r["level"]
    return out


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def line_sets(rows: DataFrame, levels: np.ndarray, threshold: float, min_words: int) -> DataFrame:
    """One row per line with at least ``min_words`` different words: its place, size, set hash, bitmap and prefix."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 20):
                some = batch.slice(a, b - a)
                words = Words(some.column(2).to_pylist())
                breaks = np.flatnonzero(words.data == 10)
                line = np.searchsorted(breaks, words.start)
                base = np.searchsorted(breaks, words.begin[:-1])
                # The id of a word: its rarity, then hash bits. Ids order words alike everywhere.
                ids = (rare[_bucket(words.hash)].astype(np.uint64) << np.uint64(56)) | (words.hash >> np.uint64(8))
                order = np.lexsort((ids, line))
                ids, line, h = ids[order], line[order], words.hash[order]
                if not len(ids):
                    continue
                fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (line[1:] != line[:-1])])
                ids, line, h = ids[fresh], line[fresh], h[fresh]
                starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                n = np.diff(np.append(starts, len(line)))
                bitmap = np.bitwise_xor.reduceat(np.uint64(1) << (h & np.uint64(63)), starts)
                total = np.add.reduceat(h * (h | np.uint64(1)), starts)
                long = n >= min_words
                if not long.any():
                    continue
                starts, n, bitmap, total = starts[long], n[long], bitmap[long], total[long]
                size = prefix_length(n, threshold)
                at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids[at].view(np.int64)))
                doc = np.searchsorted(base, line[starts], "right") - 1
                place = some.select([0, 1]).take(pa.array(doc))
                number = (line[starts] - base[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([place.column(0), place.column(1), pa.array(number), pa.array(n.astype(np.int32)), pa.array(total.view(np.int64)), pa.array(bitmap.view(np.int64)), prefix], ["doc", "row_id", "line", "n", "h", "bits", "prefix"])

    return rows.select("doc", "row_id", "_text").mapInArrow(run, "doc long, row_id long, line int, n int, h long, bits long, prefix array<long>")


def group_candidates(cols: dict[str, np.ndarray], threshold: float, most: int = NAMED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by word and place: (later, earlier, differing bits of their bitmaps, later ones that stopped at
    ``most`` candidates with earlier entries left).

    The first entry of each group meets all later ones, then the second, and so on; an entry that has its ``most``
    candidates meets no more, so a group of near copies is not compared pair by pair.
    """
    word, n, pos, bits = cols["word"], cols["n"].astype(np.int64), cols["pos"].astype(np.int64), cols["bits"]
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    size = np.diff(np.append(heads, len(word)))
    head = np.repeat(heads, size)
    nth = np.arange(len(word)) - head
    named, over = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    found: list[tuple[np.ndarray, ...]] = []
    live = np.flatnonzero(nth > 0)
    r = 0
    while len(live):
        y = head[live] + r
        total = n[live] + n[y]
        need = np.ceil(threshold / (1 + threshold) * total - 1e-9)
        ok = np.flatnonzero((np.minimum(n[live], n[y]) >= threshold * np.maximum(n[live], n[y]) - 1e-9) & (np.minimum(n[live] - pos[live], n[y] - pos[y]) >= need))
        apart = np.bitwise_count(bits[live[ok]] ^ bits[y[ok]]).astype(np.int64)
        near = apart <= total[ok] - 2 * need[ok]
        ok, apart = ok[near], apart[near]
        x = live[ok]
        found.append((x, y[ok], apart))
        named[x] += 1
        r += 1
        done = (named[live] >= most) & (nth[live] > r)
        over[live[done]] = True
        live = live[(nth[live] > r) & ~done]
    none = np.zeros(0, np.int64)
    x, y, apart = (np.concatenate([none, *c]) for c in zip(*found, strict=True)) if found else (none, none, none)
    return x, y, apart, np.flatnonzero(over)


def candidate_pairs(entries: DataFrame, threshold: float, most: int = NAMED) -> DataFrame:
    """``(row_id, line, other_row, other_line, apart)`` with the other line earlier; null others mark lines with more."""
    names = ["word", "doc", "row_id", "line", "n", "pos", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
            x, y, apart, over = group_candidates(cols, threshold, most)
            row, line = cols["row_id"], cols["line"]
            blank = pa.nulls(len(over), pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row[x], row[over]])), pa.array(np.concatenate([line[x], line[over]]).astype(np.int32)),
                    pa.concat_arrays([pa.array(row[y]), blank]), pa.concat_arrays([pa.array(line[y].astype(np.int32)), blank.cast(pa.int32())]),
                    pa.concat_arrays([pa.array(apart.astype(np.int32)), blank.cast(pa.int32())]),
                ],
                ["row_id", "line", "other_row", "other_line", "apart"],
            )

        held: list[dict[str, np.ndarray]] = []
        rows = 0
        for batch in batches:
            cols = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names if k != "doc"}
            held.append(cols | {"bits": cols["bits"].view(np.uint64)})
            rows += len(batch)
            if rows >= GROUP_ROWS:
                whole = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                last = int(np.searchsorted(whole["word"], whole["word"][-1], "left"))
                if last:
                    yield solve({k: v[:last] for k, v in whole.items()})
                held = [{k: v[last:] for k, v in whole.items()}]
                rows = len(held[0]["word"]) if last else 0
        if held:
            yield solve({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    dealt = entries.select(*names).repartition("word").sortWithinPartitions("word", "doc", "row_id", "line")
    return dealt.mapInArrow(run, "row_id long, line int, other_row long, other_line int, apart int")


def word_sets(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``(row_id, line, m int, k0..k3 long, w binary)`` of the lines ``places(row_id, line)``: how many different words they
    have, a parity bitmap of 256 bits, and the sorted 64-bit hashes of the words. A text is met once, with the list of
    its lines, which its length bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                words = Words(part.column(1).to_pylist())
                breaks = np.flatnonzero(words.data == 10)
                line = np.searchsorted(breaks, words.start)
                base = np.searchsorted(breaks, words.begin[:-1])
                many = pa.compute.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                wanted = np.repeat(base, many) + part.column(2).flatten().to_numpy(zero_copy_only=False)
                hit = np.isin(line, wanted)
                h, line = words.hash[hit], line[hit]
                if not len(h):
                    continue
                order = np.lexsort((h, line))
                h, line = h[order], line[order]
                fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])
                h, line = h[fresh], line[fresh]
                starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                doc = np.searchsorted(base, line[starts], "right") - 1
                offsets = (8 * np.append(starts, len(h))).astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(h.tobytes())])
                bit, lane = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(3)
                lanes = [np.bitwise_xor.reduceat(np.where(lane == np.uint64(j), bit, np.uint64(0)), starts).view(np.int64) for j in range(4)]
                size = np.diff(np.append(starts, len(h))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array((line[starts] - base[doc]).astype(np.int32)), pa.array(size), *map(pa.array, lanes), cells], ["row_id", "line", "m", "k0", "k1", "k2", "k3", "w"])

    lists = places.groupBy("row_id").agg(F.collect_set("line").alias("_lines"))
    near = sieve(rows.select("row_id", "_text"), "row_id", lists.select("row_id")).join(lists, "row_id").select("row_id", "_text", "_lines")
    # Rows that repeat id and text give the same sets again.
    return near.mapInArrow(run, "row_id long, line int, m int, k0 long, k1 long, k2 long, k3 long, w binary").dropDuplicates(["row_id", "line"])


def likely(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` that the large bitmaps leave, with ``apart``, the bits in which these differ: never more than the words
    in which the lines differ. Bitmaps are small, so false candidates go before any word is moved."""
    ks = ["k0", "k1", "k2", "k3"]
    told = sets.select("row_id", "line", "m", *ks)
    other = told.toDF("other_row", "other_line", "om", *[f"o{k}" for k in ks])
    met = pairs.select("row_id", "line", "other_row", "other_line").distinct().join(told, ["row_id", "line"]).join(other, ["other_row", "other_line"])
    apart = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"o{k}"))) for k in ks), F.lit(0))
    total = F.col("m") + F.col("om")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * total - F.lit(1e-9))
    return met.withColumn("apart", apart).where(F.col("apart") <= total - 2 * need).select("row_id", "line", "other_row", "other_line", "apart")


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The lines ``(row_id, line)`` of ``pairs`` whose words and those of their other line reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes = [], []
            for c in (2, 3):
                cells = batch.column(c).to_pylist()
                sizes.append(np.array([len(x) for x in cells], np.int64) // 8)
                hashes.append(np.frombuffer(b"".join(cells), np.uint64))
            pair = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in sizes])
            h = np.concatenate(hashes)
            order = np.lexsort((h, pair))
            h, pair = h[order], pair[order]
            same = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=len(batch))
            yield batch.select([0, 1]).filter(pa.array(same >= threshold * (sizes[0] + sizes[1] - same) - 1e-9))

    def some(row: str, line: str) -> DataFrame:
        """The sets that one side of the pairs names: only these are moved."""
        keyed = sets.select("row_id", "line", "w", F.xxhash64("row_id", "line").alias("key"))
        return sieve(keyed, "key", pairs.select(F.xxhash64(row, line).alias("key"))).drop("key")

    one = pairs.join(some("row_id", "line"), ["row_id", "line"])
    two = one.join(some("other_row", "other_line").select(F.col("row_id").alias("other_row"), F.col("line").alias("other_line"), F.col("w").alias("v")), ["other_row", "other_line"])
    return two.select("row_id", "line", "w", "v").mapInArrow(run, "row_id long, line int").distinct()


def prefix_entries(lines: DataFrame) -> DataFrame:
    """One row per prefix word of a line. A word that occurs once in all texts joins no two lines and is left out."""
    entries = lines.select("doc", "row_id", "line", "n", "bits", F.posexplode("prefix").alias("pos", "word"))
    return entries.where(F.shiftright("word", 56) > 0)


def kept_lines(rows: DataFrame, threshold: float = 0.8, min_words: int = 5, named_most: int = NAMED) -> DataFrame:
    """``(doc, row_id, kept array<int>)``: the lines of at least ``min_words`` words that no earlier line resembles.

    Lines of the same words are one class, named by its first line; only that one is compared. ``rows`` holds
    ``(doc, row_id, _text)``; earlier means smaller doc, row and line. A line needs one verified earlier line: its
    likeliest candidate is verified first, the others where that fails. Words are compared by hashes of 64 bits.
    """
    lines = line_sets(rows, rarity(rows, "_text"), threshold, min_words)
    place = F.struct("doc", "row_id", "line")
    first = lines.groupBy("h", "n", "bits").agg(F.min(place).alias("p"), F.min("prefix").alias("prefix"))
    firsts = cut(first.select("p.doc", "p.row_id", "p.line", "n", "bits", "prefix"), "lines")
    entries = prefix_entries(firsts)
    found = cut(candidate_pairs(entries, threshold, named_most), "pairs")
    named = found.where("other_row is not null")
    both = lambda pairs: pairs.select("row_id", "line").union(pairs.select("other_row", "other_line")).distinct()
    sets = cut(word_sets(rows, both(named)), "sets")
    near = cut(likely(sets, named, threshold), "near")
    best = near.groupBy("row_id", "line").agg(F.min(F.struct("apart", "other_row", "other_line")).alias("o")).select("row_id", "line", "o.other_row", "o.other_line")
    best = cut(best, "best")
    gone = cut(verified(sets, best, threshold), "gone")
    rest = near.select("row_id", "line", "other_row", "other_line").join(gone, ["row_id", "line"], "left_anti")
    rest = cut(rest.join(best, best.columns, "left_anti"), "rest")
    drop_cut(best)
    drop_cut(near)
    if not rest.isEmpty():
        gone = cut(gone.union(verified(sets, rest, threshold)), "gone")
    drop_cut(sets)
    more = cut(found.where("other_row is null").select("row_id", "line").distinct().join(gone, ["row_id", "line"], "left_anti"), "more")
    drop_cut(found)
    if not more.isEmpty():
        open_ = sieve(firsts.withColumn("key", F.xxhash64("row_id", "line")), "key", more.select(F.xxhash64("row_id", "line"))).drop("key")
        probe = cut(prefix_entries(open_.join(more, ["row_id", "line"], "left_semi")), "probe")
        other = sieve(entries, "word", probe.select("word").distinct()).select([F.col(c).alias(c if c == "word" else f"other_{c}") for c in entries.columns])
        n, m = F.col("n"), F.col("other_n")
        need = F.ceil(F.lit(threshold / (1 + threshold)) * (n + m) - F.lit(1e-9))
        near = F.bit_count(F.col("bits").bitwiseXOR(F.col("other_bits"))) <= n + m - 2 * need
        fits = (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - F.lit(1e-9)) & (F.least(n - F.col("pos"), m - F.col("other_pos")) >= need)
        key = lambda p: F.struct(F.col(f"{p}doc").alias("doc"), F.col(f"{p}row_id").alias("row_id"), F.col(f"{p}line").alias("line"))
        rest = probe.join(other, (probe.word == other.word) & fits & near & (key("other_") < key("")))
        rest = cut(rest.select("row_id", "line", F.col("other_row_id").alias("other_row"), "other_line").distinct(), "rest")
        sets = cut(word_sets(rows, both(rest)), "sets")
        gone = gone.union(verified(sets, likely(sets, rest, threshold), threshold)).distinct()
    return firsts.select("doc", "row_id", "line").join(gone, ["row_id", "line"], "left_anti").groupBy("doc", "row_id").agg(F.collect_list("line").alias("kept"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, min_words: int = 5, id_column: str = "doc_id", text: str = "text", named_most: int = NAMED) -> DataFrame:
    """All rows of ``docs`` with all columns, ``text`` without its repeated lines, and ``n_lines``, ``n_removed long``.

    A line goes if any earlier line (by id, then row, then line; nulls first) has word sets of Jaccard similarity
    ``threshold`` or more; A-Z is lower-cased, words are runs without ASCII white space. Lines of fewer than
    ``min_words`` different words are always kept. Rows that repeat id and text are one document. Null texts stay null
    with no line; empty texts are one line; an empty table gives no rows. Columns already named n_lines, n_removed or
    row_id go.
    """
    whole = row_ids(docs.drop("n_lines", "n_removed", "row_id"), id_column, text)
    rows = whole.select(F.col(id_column).cast("long").alias("doc"), "row_id", F.col(text).alias("_text"))
    kept = kept_lines(rows, threshold, min_words, named_most).withColumnsRenamed({"row_id": "_line_row", "doc": "_line_doc", "kept": "_line_kept"})
    joined = whole.join(kept, (F.col("row_id") == F.col("_line_row")) & F.col(id_column).cast("long").eqNullSafe(F.col("_line_doc")), "left")
    names = [c for c in whole.columns if c != "row_id"]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                out, total, gone = [], [], []
                for t, kept in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    lines = [] if t is None else t.split("\n")
                    stay = set(kept or ())
                    left = [x for j, x in enumerate(lines) if j in stay or len(x) < 2 * min_words - 1 or len(words_of_line(x)) < min_words]
                    out.append(None if t is None else "\n".join(left))
                    total.append(len(lines))
                    gone.append(len(lines) - len(left))
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"])

    fields = ", ".join(f"`{c}` {t}" for c, t in whole.dtypes if c != "row_id")
    return joined.select(*names, "_line_kept").mapInArrow(run, f"{fields}, n_lines long, n_removed long")
