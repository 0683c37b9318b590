"""Repair of the turn structure of conversations by cheapest edits.

Rows of a conversation are walked in order; what is written so far is one of four states: nothing, a system turn, a user
turn, an assistant turn. Keeping, renaming, deleting and inserting turns are arcs with small integer costs, so distances to
the end come from Dial's bucket queue; a walk over tight arcs, smallest letter first, then gives the edits.

A conversation of any length is cut into segments of bounded size by a range partitioning on its order. A segment's
distances between its ends are four rows of four numbers; those alone are combined per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state after the next turn that may be written: user after all but user, then assistant.
FOLLOWS = (2, 2, 3, 2)
WRITES = ("", "", "user", "assistant")
#: What it takes to end in each state: nothing or an assistant turn may stand last.
CLOSING = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
#: Rows and signs of a segment.
ROWS, SIGNS = 1024, 1 << 20
#: Buckets of the ring; no arc and no difference between ends is as long.
RING = 64
FAR = 1 << 60


def _arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """From each state (letter, cost, state, rows taken), letters in order. A code is 3 * role + fault: roles system, user,
    assistant, other; faults none, to be deleted, truncated."""
    role, fault = divmod(code, 3)
    more = TRUNCATED if fault == 2 else 0
    out = []
    for state, to in enumerate(FOLLOWS):
        arcs = [("D", DELETE, state, 1), ("I", INSERT, to, 0)]
        if fault != 1:
            if (role == 0 and state == 0) or (role in (1, 2) and to == role + 1):
                arcs.append(("K", more, role + 1, 1))
            arcs.append(("R", RENAME + more, to, 1))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(12)]
#: Into each state: (cost, state) of arcs that take a row.
BACK = [[[(cost, s) for s in range(4) for _, cost, t, rows in ARCS[code][s] if rows and t == to] for to in range(4)] for code in range(12)]
#: States from which an inserted turn leads to a state.
ENTERED = [[s for s in range(4) if FOLLOWS[s] == to] for to in range(4)]


def distances(codes: bytes, ends: tuple[int, ...]) -> list[int]:
    """Dial's algorithm against the arcs: the distance of every (row, state), at ``4 * row + state``, given the distances
    ``ends`` behind the last row. Turns are inserted before rows only; ``ends`` counts those behind the last."""
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    now, held = min(ends), 0
    for s, d in enumerate(ends):
        if d < FAR:
            dist[4 * n + s] = d
            ring[d % RING].append(4 * n + s)
            held += 1
    while held:
        bucket = ring[now % RING]
        while bucket:
            node = bucket.pop()
            held -= 1
            if dist[node] != now:
                continue
            i, to = divmod(node, 4)
            if i < n:
                for s in ENTERED[to]:
                    if now + INSERT < dist[4 * i + s]:
                        dist[4 * i + s] = now + INSERT
                        ring[(now + INSERT) % RING].append(4 * i + s)
                        held += 1
            if i:
                for cost, s in BACK[codes[i - 1]][to]:
                    at = 4 * i - 4 + s
                    if now + cost < dist[at]:
                        dist[at] = now + cost
                        ring[(now + cost) % RING].append(at)
                        held += 1
        now += 1
    return dist


def walk(codes: bytes, ends: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of some rows that begin in ``state``, and the state behind them."""
    dist = distances(codes, ends)
    i, out = 0, []
    while i < len(codes):
        for letter, cost, to, rows in ARCS[codes[i]][state]:
            if dist[4 * (i + rows) + to] + cost == dist[4 * i + state]:
                out.append(letter)
                i, state = i + rows, to
                break
    return "".join(out), state


def between(codes: bytes) -> list[int]:
    """Distances from each state before the rows to each state behind them, 16 numbers."""
    each = [distances(codes, tuple(0 if s == to else FAR for s in range(4)))[:4] for to in range(4)]
    return [min(each[to][s], FAR) for s in range(4) for to in range(4)]


@lru_cache(1 << 16)
def _whole(codes: bytes) -> tuple[int, str, int]:
    audit, state = walk(codes, CLOSING, 0)
    return distances(codes, CLOSING)[0], audit, state


class _Tally:
    """What is known of a conversation after some of its segments."""

    def __init__(self) -> None:
        self.counts, self.illegal, self.turns, self.low, self.high = [0, 0, 0], 0, 0, None, None
        self.initial = self.turn = None
        self.state, self.cost, self.audit = 0, 0, []
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, part: dict) -> None:
        self.counts = [a + b for a, b in zip(self.counts, part["counts"], strict=True)]
        self.illegal += part["illegal"]
        if part["codes"]:
            if self.initial is not None and self.initial + part["first"] not in LEGAL:
                self.illegal += 1
            self.initial = part["last"]
        if part["low"] is not None:
            self.turns += part["turns"] - (self.high == part["low"])
            self.low = part["low"] if self.low is None else self.low
            self.high = part["high"]

    def write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def edit(self, part: dict, audit: str, state: int) -> None:
        self.audit.append(audit)
        i = 0
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            self.state = part["codes"][i] // 3 + 1 if letter == "K" else FOLLOWS[self.state]
            self.write(part["roles"][i] if letter == "K" else WRITES[self.state], "" if letter == "I" else part["texts"][i])
            i += letter != "I"
        assert self.state == state

    def close(self) -> list:
        while CLOSING[self.state]:
            self.audit.append("I")
            self.state = FOLLOWS[self.state]
            self.write(WRITES[self.state], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
PART = [("seg", pa.int64()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("illegal_in", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("between", pa.list_(pa.int64()))]
TOLD = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CARRIED = "seg long, codes binary, roles array<string>, texts array<string>, counts array<long>, illegal_in long, first string, last string, turns long, low long, high long, between array<long>"


class _Segment:
    """Rows of one conversation in order, until there are enough."""

    def __init__(self, conv: object) -> None:
        self.conv, self.signs = conv, 0
        self.part = {"codes": bytearray(), "roles": [], "texts": [], "counts": [0, 0, 0], "illegal": 0, "first": None, "last": None, "turns": 0, "low": None, "high": None}

    def add(self, turn: int | None, role: str, text: str, shape: int, again: bool) -> None:
        """``shape``: 0 a whole text, 1 blank, 2 truncated."""
        p = self.part
        fault = 1 if shape == 1 or again else shape
        p["codes"].append(3 * ("sua".find(role[0]) % 4 if role else 3) + fault)
        p["roles"].append(role if fault != 1 else None)
        p["texts"].append(text if fault != 1 else None)
        self.signs += len(text) if fault != 1 else 0
        if shape == 1 or again or shape == 2:
            p["counts"][0 if shape == 1 else 1 if again else 2] += 1
        if p["last"] is not None and p["last"] + role[:1] not in LEGAL:
            p["illegal"] += 1
        p["first"] = role[:1] if p["first"] is None else p["first"]
        p["last"] = role[:1]
        if turn is not None:
            p["turns"] += p["high"] != turn
            p["low"] = turn if p["low"] is None else p["low"]
            p["high"] = turn

    def full(self, rows: int, signs: int) -> bool:
        return len(self.part["codes"]) >= rows or self.signs >= signs

    def row(self, seg: int | None) -> list:
        """The finished conversation, or with ``seg`` what a later step needs to finish it."""
        p = self.part
        codes = p["codes"] = bytes(p["codes"])
        if seg is not None:
            carried = [seg, codes, p["roles"], p["texts"], p["counts"], p["illegal"], p["first"], p["last"], p["turns"], p["low"], p["high"], between(codes)]
            return [self.conv, *[None] * len(RESULT), *carried]
        tally = _Tally()
        tally.add(p)
        tally.cost, audit, state = _whole(codes) if len(codes) <= 64 else (distances(codes, CLOSING)[0], *walk(codes, CLOSING, 0))
        tally.edit(p, audit, state)
        return [self.conv, *tally.close(), *[None] * len(PART)]


def _segments(batches: Iterator[pa.RecordBatch], most_rows: int, most_signs: int) -> Iterator[pa.RecordBatch]:
    """Conversations that begin and end within the sorted partition are finished; the first and the last one, which may go
    on elsewhere, and those of several segments are handed on in segments."""
    base, given = TaskContext.get().partitionId() << 32, 0
    names, types, rows, size = None, None, [], 0
    open_: _Segment | None = None
    alone = False  # whether all rows of the open segment's conversation are in it

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows.clear()
        return out

    def end(whole: bool) -> None:
        nonlocal given, size
        size += open_.signs + 200
        rows.append(open_.row(None if whole else base + given))
        given += not whole

    for one in batches:
        if names is None:
            names, types = [one.schema.names[0], *[n for n, _ in RESULT + PART]], [one.schema.types[0], *[t for _, t in RESULT + PART]]
        for conv, turn, role, text, n, shape, again in zip(*[c.to_pylist() for c in one.columns], strict=True):
            if open_ is None or open_.conv != conv:
                first = open_ is None
                if open_ is not None:
                    end(alone)
                open_, alone = _Segment(conv), not first
            for k in range(n):
                if open_.full(most_rows, most_signs):
                    end(False)
                    open_, alone = _Segment(conv), False
                open_.add(turn, role, text, shape, again or k > 0)
            if size > 1 << 22:
                yield batch()
                size = 0
    if open_ is not None:
        end(False)
        yield batch()


def _ends(group: pa.Table) -> pa.Table:
    """Distances behind each segment of a conversation, from the last one back, and the cost of the whole."""
    group = group.sort_by("seg")
    ends, out = list(CLOSING), []
    for m in reversed(group.column("between").to_pylist()):
        out.append(ends)
        ends = [min(m[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
    return pa.table({"seg": group.column("seg"), "ends": pa.array(out[::-1], pa.list_(pa.int64())), "total": pa.array([ends[0]] * len(out), pa.int64())})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the segments of each conversation in turn; only the state and the edits so far are kept."""
    conv = tally = kind = None
    names = []

    def row() -> pa.RecordBatch:
        types = [kind, *[t for _, t in RESULT]]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([conv, *tally.close()], types, strict=True)], names)

    for batch in batches:
        names, kind = [batch.schema.names[0], *[n for n, _ in RESULT]], batch.schema.types[0]
        for k in range(len(batch)):
            part = {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            part["illegal"] = part.pop("illegal_in")
            if tally is None or part[names[0]] != conv:
                if tally is not None:
                    yield row()
                conv, tally = part[names[0]], _Tally()
                tally.cost = part["total"]
            tally.add(part)
            tally.edit(part, *walk(part["codes"], tuple(part["ends"]), tally.state))
    if tally is not None:
        yield row()


def damage(rows: DataFrame, out_of: int = 20) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: damaged rows by ``crc32('conv_id:turn') % out_of``, where nulls, in role and
    text too, stand for one space. 0 drops the row (``n`` is 0), 1 empties the text, 2 takes out ``.!?``, 3 repeats the row,
    4 sets the role to user."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % out_of
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hurt = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("n"))


def repair(rows: DataFrame, segment_rows: int = ROWS, segment_signs: int = SIGNS) -> DataFrame:
    """One row for each ``conv_id`` of ``rows(conv_id, turn, role, text, n)`` with its faults and its cheapest repair.

    ``n`` says how often a row stands there; a conversation whose rows all have 0 gives zeros, an empty audit and the hash
    of nothing. Rows go by turn, nulls first, ties by role and text; a null ``conv_id`` is a conversation, roles and texts
    are not null. The first fault of a row counts: blank, duplicate (role and text stood earlier), truncated (does not end
    in ``.!?``). Edits and costs: Keep 0, Rerole 3, Delete 4 (required for blank and duplicate rows), Insert 3; a truncated
    row that stays adds 3. The audit has the initials of the cheapest edits after which role initials are
    ``(s?(ua)+)?``, the ASCII-least of several. Other columns are ignored; an empty table gives no rows.

    No conversation is held whole: equal rows are one row with a count, order is dealt by ranges, and what goes on over
    several segments is walked segment by segment. Only the audit itself grows with a conversation, and 16 numbers per
    segment of ``segment_rows`` rows meet in one task. A hash of a text is sequential by nature, so one task streams over such a conversation.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = cut(rows, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    several = rows.where("n > 0").groupBy("conv_id", "role", "text").agg(F.count("*").alias("times"), F.min(order)["turn"].alias("earliest")).where("times > 1")
    several = several.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text")], "earliest")
    same = rows.conv_id.eqNullSafe(several._conv_id) & (rows.role == several._role) & (rows.text == several._text)
    again = F.col("_role").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest"))
    core = F.expr(r"trim(TRAILING ' \t\n\u000B\f\r' FROM text)")
    shape = F.when(core == "", 1).when(F.right(core, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    told = rows.join(several, same, "left").select("conv_id", "turn", "role", "text", "n", shape.alias("shape"), again.alias("again"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ordered = told.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = rows.schema["conv_id"].dataType.simpleString()
    segments = partial(_segments, most_rows=segment_rows, most_signs=segment_signs)
    parts = cut(ordered.mapInArrow(segments, f"conv_id {kind}, {TOLD}, {CARRIED}"), "segments")
    whole = parts.where("seg is null").select("conv_id", *[n for n, _ in RESULT])
    open_ = parts.where("seg is not null").select("conv_id", *[n for n, _ in PART])
    ends = open_.select("conv_id", "seg", "between").groupBy("conv_id").applyInArrow(_ends, "seg long, ends array<long>, total long")
    joined = open_.drop("between").join(ends, "seg").select("conv_id", *[n for n, _ in PART[:-1]], "ends", "total")
    done = joined.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_finished, f"conv_id {kind}, {TOLD}")
    return whole.unionByName(done)
