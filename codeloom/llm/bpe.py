"""Byte-level BPE encoding and decoding.

Pieces are found without a regular expression. Every code point gets a class; one symbol per position (class, one
position of look-ahead, start of a document) names a transition function of an eight-state automaton. Functions
compose associatively, so all states come from a two-level prefix scan over ids of composed functions, a lookup in
the composition table per step. Where the state and the symbol open a piece there is a boundary. The piece slices go
through a cache to pair merging by rank; the byte offset of each token stays with its id.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SPACE_MORE, SPACE_JOIN, SPACE_ALONE, APOS_2, APOS_3 = range(8)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, JOINING, ONE_LEFT, TWO_LEFT = range(8)
#: Added to the symbol of the first code point of a document.
FIRST = 8
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
SLICE_BYTES = 1 << 20
CACHE_PIECES = 200_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece opens before this code point."""
    if symbol >= FIRST:
        return _step(START, symbol - FIRST)[0], True
    if symbol == LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (START if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (OTHER, APOS_2, APOS_3):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, APOS_2: ONE_LEFT, APOS_3: TWO_LEFT}[symbol], True
    if symbol == SPACE_MORE:
        return IN_SPACE, state != IN_SPACE
    return (JOINING if symbol == SPACE_JOIN else START), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, composition table, state after a function from a state, boundary table)."""
    of_symbol = [tuple(_step(q, s)[0] for q in range(8)) for s in range(16)]
    ids: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    todo = list(dict.fromkeys(of_symbol))
    for f in todo:
        ids.setdefault(f, len(ids))
    for f in todo:  # closed under composition with the generators on the right
        for g in dict.fromkeys(of_symbol):
            h = tuple(g[q] for q in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    functions = list(ids)
    n = len(functions)
    compose = np.zeros((n, n), np.uint16)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i, j] = ids[tuple(g[q] for q in f)]
    opens = np.array([[_step(q, s)[1] for s in range(16)] for q in range(8)])
    return np.array([ids[f] for f in of_symbol], np.uint16), compose.ravel(), np.array(functions, np.uint8), opens.ravel()


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE_MORE or OTHER of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    spaces = [c for c in range(0x110000) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    out[spaces] = SPACE_MORE
    return out


def scan(functions: np.ndarray, compose: np.ndarray, size: int) -> np.ndarray:
    """Inclusive prefix composition: blocks side by side, then the totals of the blocks the same way."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * size + int(functions[i])]
        return out
    width = 128 if n >= 1 << 14 else 16
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = functions
    steps = np.ascontiguousarray(padded.reshape(rows, width).T)
    for j in range(1, width):
        steps[j] = compose[steps[j - 1].astype(np.int32) * size + steps[j]]
    before = np.zeros(rows, np.int32)
    before[1:] = scan(steps[-1], compose, size)[:-1]
    return compose[before[None, :] * size + steps].T.ravel()[:n]


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where a piece opens in ``points``, documents laid end to end that begin at ``starts`` (none empty)."""
    of_symbol, compose, after, opens = automaton()
    n = len(points)
    symbol = classes()[points]
    last = np.append(starts[1:], n) - 1
    space = symbol == SPACE_MORE
    more = np.empty(n, bool)
    more[:-1] = space[1:]
    more[last] = True
    alone = space & ~more
    symbol[alone] = np.where(points[alone] == 0x20, SPACE_JOIN, SPACE_ALONE)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        end = last[np.searchsorted(starts, quote, "right") - 1]
        one = np.where(quote + 1 <= end, points[np.minimum(quote + 1, n - 1)], 0)
        two = np.where(quote + 2 <= end, points[np.minimum(quote + 2, n - 1)], 0)
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) & ((two == ord(c[1])) if len(c) == 2 else True)
            symbol[quote[hit]] = APOS_2 if len(c) == 1 else APOS_3
    symbol[starts] += FIRST
    size = len(after)
    done = scan(of_symbol[symbol], compose, size)
    before = np.zeros(n, np.uint8)
    before[1:] = after[done[:-1], START]
    return np.flatnonzero(opens[before.astype(np.int16) * 16 + symbol])


class Merger(dict):
    """Cache of piece -> ids as little-endian int32 bytes; a miss merges the pair of lowest rank, leftmost first."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE_PIECES):
        super().__init__()
        self.ranks, self.most = ranks, most

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 256:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            low = min(scores)
            if low == 1 << 30:
                break
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same order of merges for very long pieces, with a heap and a linked list instead of a scan per merge."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            end[end[i]], end[i] = 0, stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = np.array(self.merge(piece), "<i4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all token bytes end to end, start of each id in them, length of each id)."""
    ranks = load_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    length = np.zeros(size, np.int64)
    tokens = [b""] * size
    for token, i in ranks.items():
        tokens[i], length[i] = token, len(token)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, number of ids of each text)."""
    counts = np.zeros(len(texts), np.int64)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return np.zeros(0, np.int32), counts
    joined = "".join(texts[i] for i in full)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(texts[i]) for i in full])
    starts = np.cumsum(length) - length
    opens = piece_starts(points, starts)
    data = joined.encode("utf-8", "surrogatepass")
    if len(data) == len(points):
        at = opens
    else:
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = (np.cumsum(width, dtype=np.int64) - width)[opens]
    cache = merger(path)
    cuts = at.tolist()
    cuts.append(len(data))
    found = [cache[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
    each = np.fromiter(map(len, found), np.int64, len(found)) // 4
    counts[full] = np.add.reduceat(each, np.searchsorted(opens, starts))
    return np.frombuffer(b"".join(found), "<i4"), counts


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of a string column: long texts do not pile up in one step."""
    size, begin, total = column.nbytes / max(1, len(column)), 0, 0.0
    lengths = pa.compute.binary_length(column).fill_null(0).to_pylist() if size else []
    for i, n in enumerate(lengths):
        total += n
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0.0
    if begin < len(column):
        yield begin, len(column)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _encoded(texts: list[str | None], ranks_path: str) -> tuple[pa.Array, pa.Array]:
    """Lists of ids and of the bytes at which their tokens start, of some texts."""
    _, _, length = token_bytes(ranks_path)
    ids, counts = encode_texts([t or "" for t in texts], ranks_path)
    width = length[ids]
    ends = np.cumsum(width)
    first = np.cumsum(counts) - counts
    base = np.where(first > 0, ends[np.maximum(first, 1) - 1], 0) if len(ends) else np.zeros(len(counts), np.int64)
    return _lists(ids, counts), _lists(ends - width - np.repeat(base, counts), counts)


def _decoded(ids: pa.Array, at: pa.Array, ranks_path: str) -> pa.Array:
    """The bytes of each token put at its place."""
    data, begin, length = token_bytes(ranks_path)
    counts = pa.compute.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, place = ids.flatten().to_numpy(zero_copy_only=False), at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = length[flat]
    ends = np.concatenate([[0], np.cumsum(width)])
    stops = np.cumsum(counts)
    sizes = ends[stops] - ends[stops - counts]
    base = np.repeat(np.cumsum(sizes) - sizes, counts) + place
    out = np.zeros(int(sizes.sum()), np.uint8)
    inner = np.arange(len(out)) - np.repeat(ends[:-1], width)
    out[np.repeat(base, width) + inner] = data[np.repeat(begin[flat], width) + inner]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(out.tobytes())])


def _map_texts(docs: DataFrame, text: str, keep: list[str] | None, add: str, run_part: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*keep, F.col(text).alias("_text"))
    names = [x.split()[0] for x in add.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *run_part(part.column(len(keep)).to_pylist())], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{fields}{', ' if keep else ''}{add}")


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode every whole text by the ranks at ``ranks_path`` (a path every executor has).

    Returns the columns ``keep`` (``["doc_id"]`` unless given) of each row with ``ids array<int>`` and ``offsets
    array<int>``, the byte at which each token starts. A null or empty text gives empty arrays, an empty table no
    rows; repeated rows are encoded one by one; other columns, whatever their names, are not looked at. No shuffle.
    """
    return _map_texts(docs, text, keep, "ids array<int>, offsets array<int>", lambda texts: [*_encoded(texts, ranks_path)])


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and, in the same pass over the rows, ``decoded binary``: what ``decode`` makes of the ids."""

    def both(texts: list[str | None]) -> list[pa.Array]:
        ids, offsets = _encoded(texts, ranks_path)
        return [ids, offsets, _decoded(ids, offsets, ranks_path)]

    return _map_texts(docs, text, keep, "ids array<int>, offsets array<int>, decoded binary", both)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded binary``: the bytes of each token of ``ids`` put at its place of ``offsets``.

    Null or empty arrays give empty bytes. All other columns stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(1, len(batch)), 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column("ids"), part.column("offsets"), ranks_path)], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digest_ids(ids: str | Column) -> Column:
    """Lowercase hex sha256 of the decimal ids joined by one space."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
