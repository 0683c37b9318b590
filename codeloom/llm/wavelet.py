"""Token-id shards as wavelet matrices.

A shard is one binary cell: a header, the documents in it, then one bit-plane per id bit with rank counts every 512
bits. Access, counting and the k-th occurrence of a token come from the planes alone, without unpacking the ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices

MAGIC, BLOCK = b"CLWM", 512
#: Ids a shard holds before the next document opens a new one.
SHARD_IDS = 1 << 20
CACHE_WORDS, CACHE_PIECES = 400_000, 500_000


class WaveletMatrix:
    """Bit-planes from the highest id bit down; each level is the stable partition of the one above by its bit."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes
        counts = [np.bitwise_count(p.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32) for p in planes]
        self.ranks = [np.concatenate([[0], np.cumsum(c, dtype=np.uint32)]).astype(np.uint32) for c in counts]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        depth = max(1, int(ids.max()).bit_length()) if n else 1
        level = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        zeros, planes = [], []
        for k in range(depth - 1, -1, -1):
            bit = ((level >> k) & 1).astype(bool)
            plane = np.zeros(-(-n // BLOCK) * (BLOCK // 8), np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            low, high = level[~bit], level[bit]
            zeros.append(len(low))
            planes.append(plane)
            level = np.concatenate([low, high])
        return cls(n, zeros, planes)

    def to_bytes(self) -> bytes:
        head = struct.pack("<IB", self.n, len(self.planes)) + np.array(self.zeros, "<u4").tobytes()
        return head + b"".join(r.astype("<u4").tobytes() + p.tobytes() for r, p in zip(self.ranks, self.planes, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> WaveletMatrix:
        n, depth = struct.unpack_from("<IB", data)
        at = 5 + 4 * depth
        self = cls.__new__(cls)
        self.n, self.zeros, self.ranks, self.planes = n, np.frombuffer(data, "<u4", depth, 5).tolist(), [], []
        blocks = -(-n // BLOCK)
        for _ in range(depth):
            self.ranks.append(np.frombuffer(data, "<u4", blocks + 1, at))
            self.planes.append(np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + 4 * (blocks + 1)))
            at += 4 * (blocks + 1) + blocks * BLOCK // 8
        return self

    def ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        part = plane[block * BLOCK // 8 : i // 8]
        rest = int(plane[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self.ranks[level][block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, zeros in enumerate(self.zeros):
            bit = int(self.planes[k][i // 8]) >> i % 8 & 1
            ones = self.ones(k, i)
            i = zeros + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def range_of(self, token: int, stop: int) -> tuple[int, int]:
        """Where occurrences of ``token`` among the first ``stop`` ids lie on the last level."""
        depth, lo, hi = len(self.planes), 0, stop
        if token >> depth:
            return 0, 0
        for k, zeros in enumerate(self.zeros):
            a, b = self.ones(k, lo), self.ones(k, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (depth - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, stop: int | None = None) -> int:
        """How often ``token`` occurs among the first ``stop`` ids (all unless given)."""
        lo, hi = self.range_of(token, self.n if stop is None else min(stop, self.n))
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0); -1 if there are fewer."""
        lo, hi = self.range_of(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i, depth = lo + k, len(self.planes)
        for level in range(depth - 1, -1, -1):
            bit = token >> (depth - 1 - level) & 1
            i = self.find(level, i - self.zeros[level] if bit else i, bit)
        return i

    def find(self, level: int, k: int, bit: int) -> int:
        """Position of the ``k``-th bit of this value in a plane."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def all(self) -> np.ndarray:
        """Every id in order, from the last level up."""
        below = np.zeros(self.n, np.uint32)
        depth = len(self.planes)
        for k in range(depth - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            here = np.empty(self.n, np.uint32)
            here[~bit] = below[: self.zeros[k]]
            here[bit] = below[self.zeros[k] :] | np.uint32(1 << (depth - 1 - k))
            below = here
        return below


def pack_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    known = np.packbits(np.array([d is not None for d in doc_ids], bool)).tobytes()
    head = MAGIC + struct.pack("<I", len(doc_ids)) + known + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes()
    return head + WaveletMatrix.build(ids).to_bytes()


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a token shard")
    (n,) = struct.unpack_from("<I", data, 4)
    known = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8), count=n)
    at = 8 + -(-n // 8)
    ids = [d if k else None for d, k in zip(np.frombuffer(data, "<i8", n, at).tolist(), known.tolist(), strict=True)]
    return ids, np.frombuffer(data, "<u4", n, at + 8 * n), WaveletMatrix.from_bytes(memoryview(data)[at + 12 * n :])


#: Composed Latin letters that stay one of them, or of a-z, in lower case.
LETTERS = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(low := c.lower()) == 1 and (low < "\x80" or "\u00c0" <= low < "\u0250"))
#: Words in which letters, digits and the rest part alike in the tokenizer's own pattern, whatever stands around them:
#: such letters and ASCII without the apostrophe.
PLAIN = re.compile(f"[!-&(-~{LETTERS}]+")
PIECES = re.compile(f"[a-z{LETTERS}]+|[0-9]|[^a-z0-9{LETTERS}]+")


@lru_cache(1)
def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: visible Latin-1 signs stand for themselves, the
    other bytes for the signs from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(other)}


class Pieces(dict):
    """Ids of pieces of plain words as little-endian uint32 bytes, each merged once per bounded cache."""

    def __init__(self, tokenizer):  # noqa: ANN001
        self.model = tokenizer.model
        self.cells = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(byte_signs())
        cells = self.cells
        ids = self[piece] = b"".join([cells[t.id] for t in self.model.tokenize(signs)])
        return ids


class WordIds(dict):
    """Ids of words, likewise. The tokenizer drops white space and no piece crosses it; plain words fall into pieces here,
    all others go through the library whole."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        if word.isalpha():  # ASCII letters only
            ids = self.pieces[word.lower().decode()]
        else:
            t = word.decode("utf-8", "surrogatepass")
            if PLAIN.fullmatch(t) and "<|" not in t:
                ids = b"".join(map(self.pieces.__getitem__, PIECES.findall(t.lower())))
            else:
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_words(texts: list[str], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text and its end id, end to end, with the counts."""
    get, end = word_ids(path).__getitem__, np.array([end_id], "<u4").tobytes()
    found = [b"".join(map(get, t.encode("utf-8", "surrogatepass").split())) + end for t in texts]
    return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending id order as shards under ``path``.

    One range shuffle by id; each task packs its range into shards of about ``shard_ids`` ids, so memory does not grow
    with the corpus. Rows: ``part int`` and ``seq int`` (their order is the corpus order), ``n_docs``, ``n_ids``,
    ``payload`` (the wavelet matrix file). Null texts count as empty, null ids come first, repeated rows stay.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            data = pack_shard(names, counts, np.concatenate(held))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(names)], "n_ids": [total], "payload": [data]})

        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                some = batch.slice(a, b - a)
                ids, each = encode_words([t or "" for t in some.column(1).to_pylist()], tokenizer_path, end_id)
                names += some.column(0).to_pylist()
                counts += each.tolist()
                held.append(ids)
                total += len(ids)
                if total >= shard_ids:
                    yield shard()
                    names, counts, held, total, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    ordered = source.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text")
    shards = ordered.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, payload binary")
    shards.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document, from the files: its id, ``start long`` (ids before it), ``n_tokens long``, ``ids_crc32 long``.

    Starts are sums in three steps: documents in a shard, shards in a part, then one row per part.
    """
    shards = spark.read.schema("part int, seq int, n_docs long, n_ids long, payload binary").parquet(path)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("shard_start")).join(parts, "part").select("part", "seq", (F.col("shard_start") + F.col("part_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                names, counts, matrix = unpack_shard(data)
                raw = matrix.all().astype("<u4").tobytes()
                ends = np.cumsum(counts, dtype=np.int64)
                begin = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "_id": pa.array(names, pa.int64()), "local": begin, "n_tokens": counts.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    docs = shards.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, _id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select(F.col("_id").alias(id_column), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokens_where(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of one token per shard, by rank on the planes: ``part, seq, n long``, ``first long`` (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m.rank(token), m.select(token, 0)) for m in (unpack_shard(d)[2] for d in batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["part", "seq", "n", "first"])

    return spark.read.parquet(path).select("part", "seq", "payload").mapInArrow(run, "part int, seq int, n long, first long")
