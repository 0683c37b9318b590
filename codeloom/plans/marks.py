"""Running sums and neighbours over the tokens of whole modules, as arrays inside the tasks of ``tokens.marked_tokens``.

Spark deals and writes the texts. Here the texts of some modules at a time become arrays with an element a token, and each
mark is a running sum, a running last value, a shift, or a sort of the brackets; only marks that a question needs are made.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ``n, text, kind`` of another token.
TOKEN_TYPE = pa.struct([("n", pa.int32()), ("text", pa.string()), ("kind", pa.string())])
_SCHEMA = "n int, text string, kind string"
TYPES = {
    "asks": "string", "path": "string", "n": "int", "at": "long", "total": "int", "text": "string", "kind": "string", "p1": f"struct<{_SCHEMA}>", "f1": f"struct<{_SCHEMA}>", "second": "string", "exported": "boolean", "opens": "boolean", "closes": "boolean",
    "block": "long", "level": "int", "routine": "string", "head_at": "long", "head": "boolean", "heading": "boolean", "late": "boolean", "conditional": "boolean", "variable": "boolean", "given": "string",
    "made": "struct<name: string, type: string>", "argument": "struct<at: long, place: long>", "tokens": "array<struct<text: string, kind: string>>",
    "header": "struct<kind: string, name: string, is_export: boolean, start_line: int, end_line: int, parameters: array<string>, total: int, required: int, body_line: int, body_at: long>", "idle": "array<string>", "returns": "boolean",
    "call": "struct<line: int, callee: string, qualifier: string, method: string, args: int, used: boolean, nested: boolean>", "passed": "array<struct<place: long, root: string>>", "root": "string",
    "target": "struct<name: string, variable: boolean, given: boolean>", "type": "string",
    "closing": f"struct<at: long, n: int, next: struct<{_SCHEMA}>>", "listed": "array<struct<text: string, kind: string>>", "until": "int",
    "group": f"struct<callee: string, begins: struct<{_SCHEMA}>, before: struct<{_SCHEMA}>, chained: boolean, header: boolean, c: struct<at: long, n: int, next: struct<{_SCHEMA}>>, args: int, nested: boolean>",
}


def whole_modules(batches: Iterator[pa.RecordBatch], some: int = 20_000) -> Iterator[pa.Table]:
    """Rows of whole modules, about ``some`` or more at a time, from rows that are sorted by the first column."""
    held, rows, need = [], 0, some
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < need:
            continue
        t = pa.Table.from_batches(held)
        # The last module may go on in the next batch.
        start = pc.index(t.column(0), t.column(0)[-1]).as_py()
        if start:
            yield t.slice(0, start)
        held, rows = t.slice(start).to_batches(), len(t) - start
        need = max(some, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


class Words:
    """What a token's text alone tells, for each different text once."""

    def __init__(self, texts: list[str], w) -> None:  # noqa: ANN001
        low = [t.lower() for t in texts]
        self.kind = np.array([w.kind_of(t, x) for t, x in zip(texts, low, strict=True)], object)
        key = self.kind == "k"
        of = lambda *words: np.array([x in words for x in low], bool)
        self.heads, self.variable, self.returns, self.new = key & of(*w.HEADS), key & of(*w.VARIABLE), key & of(*w.RETURN), of(*w.NEW)
        self.marks, self.export, self.block_end = key & of(*w.HEADS, *w.ENDS), key & of(*w.EXPORT), key & of(*w.BLOCK_END)
        self.name, self.literal, self.key = self.kind == "c", self.kind == "l", key
        self.opens, self.closes, self.round, self.comma, self.end = of("(", "["), of(")", "]"), of("("), of(","), of(";")
        self.loop = key & of("для", "каждого", "for", "each")
        self.dot, self.equal, self.shut = of("."), of("="), of(")")
        self.dotted = self.name & np.array(["." in t for t in texts], bool)
        self.plain = self.name & ~self.dotted & np.array(["[" not in t for t in texts], bool)
        self.operator, self.begins = self.kind == "o", key & of(*w.BEGINS)
        self.binary, self.condition = self.operator & of(*w.BINARY), key & of(*w.CONDITION)
        self.expression, self.statement, self.function = key & of(*w.EXPRESSION), key & of(*w.STATEMENT), of("функция", "function")
        self.apart = np.isin(self.kind, ("d", "a", "l", "c"))
        # One number for all spellings of a text.
        numbers = {x: i for i, x in enumerate(dict.fromkeys(low))}
        self.low_texts, self.low = list(numbers), np.fromiter((numbers[x] for x in low), np.int64, len(low))
        forks = {"#если": 1, "#if": 1, "#конецесли": -1, "#endif": -1}
        self.fork = np.array([forks.get(w.directive(x), 0) if k == "d" else 0 for x, k in zip(low, self.kind, strict=True)], np.int64)


def coded(texts: list[str], pattern: re.Pattern) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts but comments, as codes into their different texts, with those texts; of each token the number of its
    text and its line, and of each text the number of its lines. Strings over several lines become one token a line."""
    found = [pattern.findall(t) for t in texts]
    module = np.repeat(np.arange(len(found)), [len(f) for f in found])
    all_ = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    code, words = all_.indices.to_numpy(), all_.dictionary.to_pylist()
    split = [re.split(r"\r\n|\r|\n", w) for w in words]
    breaks = np.array([w in ("\n", "\r", "\r\n") for w in words], bool)
    several = [i for i, s in enumerate(split) if len(s) > 1 and not breaks[i]]
    if several:
        end = int(np.flatnonzero(breaks)[0]) if breaks.any() else len(words)
        if end == len(words):
            words.append("\n")
            breaks = np.append(breaks, True)
        times = np.ones(len(words), np.int64)
        into = {}
        for i in several:
            first, *more = split[i]
            into[i] = [len(words)]
            words.append(first)
            for s in more:
                into[i] += [end, len(words)]
                words.append('"' + s)
            times[i] = len(into[i])
        breaks = np.append(breaks, np.zeros(len(words) - len(breaks), bool))
        flat = np.fromiter(chain.from_iterable(into.get(i, (i,)) for i in range(len(times))), np.int64)
        each = times[code]
        place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        code, module = flat[np.repeat((np.cumsum(times) - times)[code], each) + place], np.repeat(module, each)
    is_break = breaks[code]
    passed = np.cumsum(is_break)
    totals = np.bincount(module[is_break], minlength=len(texts))
    line = passed - (np.cumsum(totals) - totals)[module] + 1
    kept = ~is_break & ~np.array([w.startswith("//") for w in words], bool)[code] if len(words) else is_break
    return code[kept], pa.array(words, pa.string()), module[kept], line[kept], totals + 1


def marks_of(t: pa.RecordBatch, words, questions: dict[str | None, list[str]]) -> dict[str | None, pa.RecordBatch]:  # noqa: ANN001
    """The marked tokens of modules ``(path, text)``: for each question, which names the tokens it is about (see ``asked``),
    its columns."""
    t = t.filter(pc.is_valid(t.column(1)))
    code, texts, owner, n, totals = coded(t.column(1).to_pylist(), words.signs())
    count = len(code)
    if not count:
        return {}
    w = Words(texts.to_pylist(), words)
    kinds = pa.array(w.kind, pa.string())
    here = np.arange(count)
    starts_line = np.concatenate([[True], (owner[1:] != owner[:-1]) | (n[1:] != n[:-1])])
    at = n * words.LINE + here - np.maximum.accumulate(np.where(starts_line, here, 0))
    module = owner
    begin = np.flatnonzero(np.concatenate([[True], module[1:] != module[:-1]]))
    module = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, count)))
    first = begin[module]

    def total(x: np.ndarray) -> np.ndarray:
        """Running sum within a module, this token included."""
        s = np.cumsum(x)
        return s - (s[begin] - x[begin])[module]

    def last(hit: np.ndarray) -> np.ndarray:
        """Place of the last token of the module with ``hit``, this one included; -1: none."""
        p = np.maximum.accumulate(np.where(hit, here, -1))
        return np.where(p >= first, p, -1)

    def back(k: int) -> np.ndarray:
        return np.where(here - k >= first, here - k, -1)

    def ahead(k: int) -> np.ndarray:
        p = np.minimum(here + k, count - 1)
        return np.where((here + k < count) & (module[p] == module), here + k, -1)

    def told(flag: np.ndarray, p: np.ndarray) -> np.ndarray:
        """A flag of the texts at the tokens ``p``; false where there is none."""
        return flag[code[p]] & (p >= 0)

    def of(column: np.ndarray, p: np.ndarray, none: int) -> np.ndarray:
        return np.where(p >= 0, column[p], none)

    def index(p: np.ndarray) -> pa.Array:
        return pa.array(code[p], pa.int64(), mask=p < 0)

    def texts_at(p: np.ndarray) -> pa.Array:
        return texts.take(index(p))

    def numbers(x: np.ndarray, gone: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:  # noqa: B008
        return pa.array(x, kind, mask=gone)

    def tokens_at(p: np.ndarray) -> pa.Array:
        i = index(p)
        return pa.StructArray.from_arrays([numbers(n[p], p < 0, pa.int32()), texts.take(i), kinds.take(i)], fields=list(TOKEN_TYPE), mask=pa.array(p < 0))

    def pairs(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Lists of text and kind: of the tokens ``p``, those numbered from ``lo`` up to ``hi``."""
        size = np.maximum(hi - lo, 0)
        ends = np.cumsum(size)
        i = pa.array(code[p[np.arange(int(size.sum())) + np.repeat(lo - (ends - size), size)]], pa.int64())
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([texts.take(i), kinds.take(i)], names=["text", "kind"]))

    opens, closes, marks = w.opens[code], w.closes[code], w.marks[code]
    resets = w.end[code] | marks
    p1, f1, f2 = back(1), ahead(1), ahead(2)
    depth, block = total(opens.astype(np.int64) - closes), total(resets.astype(np.int64))
    head = w.heads[code] & told(w.name, f1)
    event = last(marks)
    inside = (event >= 0) & head[event]
    level = depth - of(depth, last(resets), 0) + closes
    bracket = opens & (level > 0)

    @cache
    def late() -> np.ndarray:
        return told(w.end, p1) & (of(block, last(w.returns[code]), -2) == block - 1) & inside & ~resets & ~w.block_end[code] & (w.kind[code] != "d")

    @cache
    def conditional() -> np.ndarray:
        forks, fall = total(w.fork[code]), module * (2 * count + 2)
        return forks - np.minimum(np.minimum.accumulate(forks - fall) + fall, 0) > 0

    @cache
    def brackets() -> tuple[np.ndarray, ...]:
        """The end and the number of values of each opening; of each token ``at`` of the bracket around it, its place there, and the
        number of that bracket among all tokens."""
        # Brackets by their level in a statement; one inside another is a value of the outer group too.
        own, outer = np.flatnonzero(level > 0), np.flatnonzero(opens & (level > 1))
        place, deep = np.concatenate([own, outer]), np.concatenate([level[own], level[outer] - 1])
        starts = opens[place] & (np.arange(len(place)) < len(own))
        order = np.lexsort((place, deep, (np.cumsum(resets) + module)[place]))
        place, deep, starts = place[order], deep[order], starts[order]
        statement = (np.cumsum(resets) + module)[place]
        comma = w.comma[code[place]]
        commas, values = np.cumsum(comma), np.cumsum(~comma & ~starts & ~closes[place])
        rows = np.arange(len(place))
        group = np.flatnonzero(np.concatenate([[True], (statement[1:] != statement[:-1]) | (deep[1:] != deep[:-1])])) if len(place) else rows
        group_first = np.repeat(group, np.diff(np.append(group, len(place))))
        opened = np.maximum.accumulate(np.where(starts, rows, -1)) if len(rows) else rows
        some = np.flatnonzero((opened >= group_first) & ~(opens[place] & ~starts))
        argument_at, argument_place, around = np.full(count, -1), np.zeros(count, np.int64), np.full(count, -1)
        argument_at[place[some]], argument_place[place[some]], around[place[some]] = at[place[opened[some]]], commas[some] - commas[opened[some]], place[opened[some]]
        edges = np.flatnonzero(starts | closes[place])
        follows = np.append(edges[1:], -1)
        shut = (follows >= 0) & (statement[follows] == statement[edges]) & (deep[follows] == deep[edges]) & closes[place[follows]] if len(edges) else edges.astype(bool)
        closing, args = np.full(count, -1), np.full(count, -1)
        is_start = starts[edges]
        x, y = edges[is_start & shut], follows[is_start & shut]
        closing[place[x]] = place[y]
        args[place[x]] = commas[y] - commas[x] + (values[y] > values[x])
        return closing, args, argument_at, argument_place, around

    @cache
    def alone() -> np.ndarray:
        return w.plain[code] & (told(w.round, p1) | told(w.comma, p1)) & (told(w.shut, f1) | told(w.comma, f1)) & (brackets()[2] >= 0)

    @cache
    def maker() -> np.ndarray:
        """Where an object is created up to this token, the place of the name that takes it."""
        p2, p3 = back(2), back(3)
        bare = w.name[code] & told(w.new, p1) & told(w.equal, p2)
        quoted = w.literal[code] & told(w.round, p1) & told(w.new, p2) & told(w.equal, p3)
        return np.where(bare, p3, np.where(quoted, back(4), -1))

    @cache
    def makes() -> np.ndarray:
        p2, p3 = back(2), back(3)
        return (w.name[code] & told(w.new, p1) & told(w.equal, p2)) | (w.literal[code] & told(w.round, p1) & told(w.new, p2) & told(w.equal, p3))

    @cache
    def given() -> np.ndarray:
        p2 = back(2)
        return np.where(told(w.equal, p1) & told(w.name, p2), p2, -1)

    @cache
    def variable() -> np.ndarray:
        return of(block, last(w.variable[code]), -1) == block

    def heading() -> np.ndarray:
        return inside & (of(block, event, -1) == block)

    @cache
    def targets() -> np.ndarray:
        """Names that are assigned, declared or run over by a loop."""
        begins = (p1 < 0) | ((told(w.end, p1) | told(w.shut, p1)) & told(w.operator, p1)) | told(w.begins, p1) | (told(w.apart, p1) & (of(n, p1, 0) < n))
        return w.plain[code] & ((begins & told(w.equal, f1) & (level == 0)) | told(w.loop, p1) | variable())

    @cache
    def routines() -> tuple[np.ndarray, np.ndarray]:
        """Headers and the last line of each. Names that repeat under a condition are one routine with the first, as long as the
        longest; a header whose bracket never closes is none."""
        found = np.flatnonzero(head & (~told(w.round, f2) | (of(brackets()[0], f2, -1) >= 0)))
        event_at = np.append(np.flatnonzero(marks), count)
        after = np.minimum(event_at[np.searchsorted(event_at, found, "right").clip(max=len(event_at) - 1)], count - 1)
        end = np.maximum(n[f1[found]], np.where((after > found) & (module[after] == module[found]) & marks[after], n[after], totals[owner[found]]))
        name = module[found] * len(w.low_texts) + w.low[code[f1[found]]]
        order = np.lexsort((found, name))
        fresh = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else order.astype(bool)
        fresh |= ~conditional()[found[order]]
        starts = np.flatnonzero(fresh)
        longest = np.maximum.reduceat(end[order], starts) if len(starts) else end
        kept = order[starts]
        back_to = np.argsort(kept)
        return found[kept][back_to], longest[back_to]

    @cache
    def parameters() -> list[tuple[list[str], int]]:
        """Of each routine its parameters, and how many of them have no default. A name counts where nothing or a comma stands
        before it, so values after "=" do not."""
        own = np.flatnonzero((level == 1) & (w.name | w.comma | w.equal)[code])
        k = routines()[0]
        first = np.where(told(w.round, f2[k]), f2[k], -1)
        end = of(brackets()[0], first, -1)
        held: dict[bytes, tuple[list[str], int]] = {}
        out = []
        for a, b in zip(np.searchsorted(own, first).tolist(), np.where(end < 0, 0, np.searchsorted(own, end)).tolist(), strict=True):
            some = code[own[a:b]] if b > a else code[:0]
            if (key := some.tobytes()) not in held:
                names = {}
                for i, c in enumerate(some.tolist()):
                    if w.name[c] and (not i or w.comma[some[i - 1]]):
                        names.setdefault(int(w.low[c]), c)
                default = np.flatnonzero(w.equal[some])
                least = min(len(names), int(w.comma[some[: default[0]]].sum())) if len(default) else len(names)
                held[key] = (list(names.values()), least)
            out.append(held[key])
        return out

    def header() -> pa.Array:
        ends = routines()[1]
        end = of(brackets()[0], np.where(told(w.round, f2[k]), f2[k], -1), -1)
        lists = [x for x, _ in parameters()]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), texts.take(pa.array(list(chain.from_iterable(lists)), pa.int64())))
        last_sign = np.where(end >= 0, end, k)
        return struct({
            "kind": pa.array(np.where(w.function[code[k]], "Function", "Procedure").astype(object), pa.string()), "name": texts_at(f1[k]), "is_export": pa.array(np.where(end >= 0, told(w.export, of(f1, end, -1)), told(w.export, f2[k]))),
            "start_line": pa.array(n[f1[k]], pa.int32()), "end_line": pa.array(ends, pa.int32()), "parameters": listed, "total": pa.array(sizes, pa.int32()), "required": pa.array([x for _, x in parameters()], pa.int32()),
            "body_line": pa.array(np.where(end >= 0, n[end], n[f1[k]]) + 1, pa.int32()), "body_at": pa.array(at[last_sign]),
        }, np.zeros(len(k), bool))

    @cache
    def spelled() -> tuple[dict[str, int], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
        """Numbers of the names in code, without case, and how often names with these numbers occur in the scopes given by their
        place: a header, or for -1 - m the whole module m. Members of chains and names in indexes count too."""
        of_word = [[x.lower() for x in words.names_of(t)] if name else () for t, name in zip(texts.to_pylist(), w.name.tolist(), strict=True)]
        numbers = {x: i for i, x in enumerate(dict.fromkeys(chain.from_iterable(of_word)))}
        size = np.fromiter(map(len, of_word), np.int64, len(of_word))
        flat = np.fromiter((numbers[x] for x in chain.from_iterable(of_word)), np.int64, int(size.sum()))
        # Only names that are declared somewhere are asked for.
        declared = np.zeros(len(numbers), bool)
        for c in {*chain.from_iterable(x for x, _ in parameters()), *np.unique(code[variable() & w.plain[code]]).tolist()}:
            declared[flat[np.cumsum(size)[c] - size[c]]] = True
        p = np.flatnonzero(w.name[code])
        each = size[code[p]]
        place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        name = flat[np.repeat((np.cumsum(size) - size)[code[p]], each) + place]
        some = np.flatnonzero(declared[name])
        p, name = np.repeat(p, each)[some], name[some]
        scopes = np.concatenate([event[p][inside[p]], -1 - module[p]])
        keys, times = np.unique((scopes + len(begin)) * (len(numbers) + 1) + np.concatenate([name[inside[p]], name]), return_counts=True)

        def often(scope: np.ndarray, name: np.ndarray) -> np.ndarray:
            key = (scope + len(begin)) * (len(numbers) + 1) + name
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[i] == key, times[i], 0) if len(keys) else np.zeros(len(key), np.int64)

        return numbers, often

    def idle() -> pa.Array:
        """Of a routine the parameters that occur in it only once, where they are declared; of a name after ``Перем`` itself, where
        that holds for it in its routine, or in the module for variables of the module."""
        numbers, often = spelled()
        number = lambda c: np.array([numbers.get(w.low_texts[i], -1) for i in w.low[c].tolist()], np.int64)
        if only == "header":
            lists = [x for x, _ in parameters()]
            owner_ = np.repeat(np.arange(len(k)), [len(x) for x in lists])
            c = np.fromiter(chain.from_iterable(lists), np.int64, len(owner_))
            scope = k[owner_]
        else:
            owner_ = np.flatnonzero(variable()[k])
            c, scope = code[k[owner_]], np.where(inside, event, -1 - module)[k[owner_]]
        once = often(scope, number(c)) <= 1
        sizes = np.bincount(owner_[once], minlength=len(k))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), texts.take(pa.array(c[once], pa.int64())))

    def returns() -> pa.Array:
        """Whether any routine of the name has the word that returns."""
        name = module * len(w.low_texts) + w.low[code[of(f1, event, 0)]]
        return pa.array(np.isin(module[k] * len(w.low_texts) + w.low[code[f1[k]]], name[w.returns[code] & inside]))

    @cache
    def chains() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the chain before an opening begins, and what stands before it. A chain may go on after a line end at its dots: up
        to three parts, ``goes`` for two and ``on`` for three."""
        p2, p3, p4, p5, p6 = (back(i) for i in range(2, 7))
        goes = told(w.dot, p2) & told(w.name, p3)
        on = goes & told(w.dot, p4) & told(w.name, p5)
        return np.where(on, p5, np.where(goes, p3, p1)), np.where(on, p6, np.where(goes, p4, p2)), goes, on

    @cache
    def calls() -> np.ndarray:
        return bracket & w.round[code] & told(w.name, p1) & (of(n, p1, -1) == n) & ~told(w.heads, back(2)) & ~told(w.key & w.new, chains()[1])

    @cache
    def nested() -> np.ndarray:
        reach = np.maximum.accumulate(np.where(calls(), brackets()[0], -1))
        return np.append(-1, reach[:-1]) > here

    def names_before(k: np.ndarray) -> list[str]:
        """The whole chain before each opening that goes on over dots of their own."""
        _, _, _, on = chains()
        parts = lambda j: (back(5)[j], back(3)[j], p1[j]) if on[j] else (back(3)[j], p1[j])
        return [".".join(texts[int(code[p])].as_py() for p in parts(j)) for j in k.tolist()]

    def call() -> pa.Array:
        begins, before, goes, _ = chains()
        closing, args = brackets()[:2]
        b, after = before[k], of(f1, of(closing, k, -1), -1)
        start = (b < 0) | (of(n, b, 0) < n[begins[k]])
        # 1: used, 0: not, -1: not clear.
        first = np.select([start, told(w.binary, b), told(w.end, b), told(w.expression, b), told(w.statement, b)], [0, 1, 0, 1, 0], -1)
        used = np.where(told(w.binary, after) | told(w.condition, after), 1, first)
        split = np.flatnonzero(goes[k])
        known, number = np.unique(code[p1[k]], return_inverse=True)
        names = [words.named(texts[int(c)].as_py()) for c in known]
        number[split] = len(names) + np.arange(len(split))
        names += [words.named(x) for x in names_before(k[split])]
        callee, qualifier, method = (pa.array([x[i] for x in names], pa.string()).take(pa.array(number)) for i in range(3))
        return struct({
            "line": pa.array(n[begins[k]], pa.int32()), "callee": callee, "qualifier": qualifier, "method": method, "args": pa.array(args[k], pa.int32()),
            "used": pa.array(used == 1, mask=used < 0), "nested": pa.array(nested()[k]),
        }, np.zeros(len(k), bool))

    def scope_of(p: np.ndarray) -> np.ndarray:
        """A number for the name of the routine around each token."""
        return np.where(inside[p], module[p] * len(texts) + code[of(f1, event, 0)[p]], -1)

    @cache
    def last_assigned() -> np.ndarray:
        """The last assignment of each variable of a routine, without case."""
        p = np.flatnonzero(targets() & told(w.equal, f1) & inside)
        scope, name = scope_of(p), w.low[code[p]]
        order = np.lexsort((p, name, scope))
        scope, name = scope[order], name[order]
        return np.sort(p[order[np.concatenate([(scope[1:] != scope[:-1]) | (name[1:] != name[:-1]), [True]])]]) if len(p) else p

    @cache
    def led() -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """Scopes with names of the variables that take the value of another one, in order, and where the chains of these end:
        each step doubles their reach, and what still moves when that is more than the variables goes round in a circle, which
        has no end."""
        p = last_assigned()
        types, sources = type_(p).to_pylist(), source(p).to_pylist()
        some = np.flatnonzero([t is None and x is not None for t, x in zip(types, sources, strict=True)])
        p, sources = p[some], [sources[i] for i in some]
        numbers = {x: i for i, x in enumerate(w.low_texts)}
        key = lambda scope, name: scope * (len(w.low_texts) + 1) + name
        own = key(scope_of(p), w.low[code[p]])
        order = np.argsort(own)
        p, own, sources = p[order], own[order], [sources[i] for i in order]
        wanted = key(scope_of(p), np.fromiter((numbers.get(x, len(w.low_texts)) for x in sources), np.int64, len(sources)))
        place = np.minimum(np.searchsorted(own, wanted), max(len(own) - 1, 0))
        on = own[place] == wanted if len(own) else np.zeros(0, bool)
        to, reach = np.where(on, place, np.arange(len(own))), 1
        while reach < len(own):
            to, reach = to[to], 2 * reach
        return own, p, [None if on[i] else sources[i] for i in to.tolist()]

    def ends_of(p: np.ndarray) -> list[str | None]:
        """Where the chain of each of these names ends; null where they take the value of no other one."""
        own, _, ends = led()
        if not len(own):
            return [None] * len(p)
        wanted = scope_of(p) * (len(w.low_texts) + 1) + w.low[code[p]]
        place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return [ends[i] if hit else None for i, hit in zip(place.tolist(), (own[place] == wanted).tolist(), strict=True)]

    def passed() -> pa.Array:
        """The arguments of a call that are one plain name each: their places, and where the chains of these names end."""
        p = np.flatnonzero(alone())
        around, place = brackets()[4][p], brackets()[3][p]
        order = np.lexsort((place, around))
        p, around, place = p[order], around[order], place[order]
        lo, hi = np.searchsorted(around, k), np.searchsorted(around, k, "right")
        ends = np.cumsum(hi - lo)
        i = np.arange(int((hi - lo).sum())) + np.repeat(lo - (ends - (hi - lo)), hi - lo)
        roots = pa.array([x or w.low_texts[c] for x, c in zip(ends_of(p[i]), w.low[code[p[i]]].tolist(), strict=True)], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.StructArray.from_arrays([pa.array(place[i], pa.int64()), roots], names=["place", "root"]))

    def least_of(k: np.ndarray, statement: np.ndarray, name: np.ndarray, text: list[str]) -> pa.Array:
        """For the tokens ``k`` the least text that their name has in their statement; null where it has none."""
        held: dict[tuple[int, int], str] = {}
        for s, c, x in zip(statement.tolist(), code[name].tolist(), text, strict=True):
            if (s, c) not in held or x < held[s, c]:
                held[s, c] = x
        own = zip((np.cumsum(resets) + module)[k].tolist(), code[k].tolist(), told(w.equal, f1)[k].tolist(), strict=True)
        return pa.array([held.get((s, c)) if equal else None for s, c, equal in own], pa.string())

    def type_(k: np.ndarray) -> pa.Array:
        """What the assignment creates by ``Новый T`` or ``Новый("T")``."""
        p = np.flatnonzero(makes() & (maker() >= 0))
        return least_of(k, (np.cumsum(resets) + module)[p], maker()[p], [x.replace('"', "") if w.literal[c] else x for x, c in zip(texts_at(p).to_pylist(), code[p].tolist(), strict=True)])

    def source(k: np.ndarray) -> pa.Array:
        """The variable whose value or copy an assignment takes."""
        p = np.flatnonzero(w.name[code] & (given() >= 0) & (told(w.end, f1) | told(w.round, f1)))
        each = zip(texts_at(p).to_pylist(), w.plain[code[p]].tolist(), told(w.end, f1)[p].tolist(), strict=True)
        text = [(t.lower() if plain else None) if alias else words.copied(t) for t, plain, alias in each]
        some = np.flatnonzero([x is not None for x in text])
        return least_of(k, (np.cumsum(resets) + module)[p[some]], given()[p[some]], [text[i] for i in some])

    asked = {
        None: lambda: here >= 0, "group": lambda: bracket, "name": lambda: w.name[code], "return": lambda: w.returns[code], "late": late, "line": lambda: starts_line,
        "target": lambda: w.name[code] & (variable() | told(w.equal, f1) | told(w.loop, p1)), "made": makes, "argument": alone, "given": lambda: w.name[code] & (given() >= 0), "directive": lambda: w.kind[code] == "d",
        "call": calls, "assigned": targets, "variable": lambda: np.isin(here, last_assigned()), "access": lambda: w.dotted[code], "read": lambda: w.name[code] & ~targets(),
    }

    def struct(of_: dict[str, pa.Array], gone: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays(list(of_.values()), names=list(of_), mask=pa.array(gone))

    def closed(p: np.ndarray) -> pa.Array:
        """The ends of brackets at tokens ``p``, with what follows them."""
        end = of(brackets()[0], p, -1)
        return struct({"at": pa.array(at[end]), "n": pa.array(n[end], pa.int32()), "next": tokens_at(of(f1, end, -1))}, end < 0)

    def groups() -> pa.Array:
        closing, args = brackets()[:2]
        begins, before, goes, _ = chains()
        chained = w.round[code] & told(w.name, p1) & (of(n, p1, -1) == n)
        header = told(w.heads, back(2))
        none = ~bracket[k]
        callee = texts_at(np.where(bracket, p1, -1)[k])
        if (split := np.flatnonzero((bracket & goes)[k])).size:
            whole = callee.to_pylist()
            for i, x in zip(split.tolist(), names_before(k[split]), strict=True):
                whole[i] = x
            callee = pa.array(whole, pa.string())
        return struct({
            "callee": callee, "begins": tokens_at(np.where(none, -1, begins[k])), "before": tokens_at(np.where(none, -1, before[k])), "chained": pa.array(chained[k]), "header": pa.array(header[k]),
            "c": closed(np.where(none, -1, k)), "args": pa.array(args[k], pa.int32()), "nested": pa.array(nested()[k]),
        }, none)

    def opening() -> np.ndarray:
        """The bracket of a header."""
        return np.where(head & told(w.round, f2), f2, -1)[k]

    def listed() -> pa.Array:
        own, first = np.flatnonzero((level == 1) & ~opens & ~closes), opening()
        end = of(brackets()[0], first, -1)
        return pairs(own, np.searchsorted(own, first), np.where(end < 0, 0, np.searchsorted(own, end)))

    def until() -> pa.Array:
        event_at = np.append(np.flatnonzero(marks), count)
        p = event_at[np.searchsorted(event_at, k, "right").clip(max=len(event_at) - 1)]
        here_too = (p < count) & (module[np.minimum(p, count - 1)] == module[k])
        return numbers(n[np.minimum(p, count - 1)], ~here_too, pa.int32())

    made = {
        "path": lambda: t.column(0).take(pa.array(owner[k])), "n": lambda: pa.array(n[k], pa.int32()), "at": lambda: pa.array(at[k]), "total": lambda: pa.array(totals[owner[k]], pa.int32()),
        "text": lambda: texts_at(k), "kind": lambda: kinds.take(index(k)), "p1": lambda: tokens_at(p1[k]), "f1": lambda: tokens_at(f1[k]), "second": lambda: texts_at(f2[k]), "exported": lambda: pa.array(told(w.export, f2)[k]),
        "opens": lambda: pa.array(opens[k]), "closes": lambda: pa.array(closes[k]), "block": lambda: pa.array(block[k]), "level": lambda: pa.array(level[k], pa.int32()), "routine": lambda: texts_at(np.where(inside, of(f1, event, -1), -1)[k]),
        "head_at": lambda: numbers(at[event][k], ~inside[k]), "head": lambda: pa.array(head[k]), "heading": lambda: pa.array(heading()[k]), "late": lambda: pa.array(late()[k]), "conditional": lambda: pa.array(conditional()[k]),
        "variable": lambda: pa.array(variable()[k]), "given": lambda: texts_at(given()[k]), "made": lambda: struct({"name": texts_at(maker()[k]), "type": texts_at(np.where(maker() >= 0, here, -1)[k])}, ~makes()[k]),
        "argument": lambda: struct({"at": pa.array(brackets()[2][k]), "place": pa.array(brackets()[3][k])}, ~alone()[k]), "group": groups,
        "closing": lambda: closed(opening()), "listed": listed, "until": until, "tokens": lambda: pairs(here, k, np.append(k[1:], count)),
        "header": header, "idle": idle, "returns": returns, "call": call, "passed": passed, "type": lambda: type_(k), "root": lambda: pa.array(ends_of(k), pa.string()),
        "target": lambda: struct({"name": texts_at(k), "variable": pa.array(variable()[k]), "given": pa.array(told(w.equal, f1)[k])}, np.zeros(len(k), bool)),
    }
    out = {}
    for only, columns in questions.items():
        k = routines()[0] if only == "header" else np.flatnonzero(asked[only]())
        out[only] = pa.RecordBatch.from_arrays([made[c]() for c in columns], names=columns)
    return out


def marked(batches: Iterator[pa.RecordBatch], words, questions: dict[str | None, list[str]], columns: list[str], some: int = 1 << 20) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Marks of about ``some`` bytes of text at a time, or of one module where that is longer: the rows of one question after
    those of another, with all ``columns``; ``asks`` names the question, what it does not ask for is null."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.concatenate([[True], size[1:] // some != size[:-1] // some])) if len(size) else size
        for a, b in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
            found = marks_of(batch.slice(a, b - a), words, questions)
            kinds = {x.name: x.type for out in found.values() for x in out.schema}
            for only, out in found.items():
                told = {"asks": pa.array([only] * len(out), pa.string())} | dict(zip(out.schema.names, out.columns, strict=True))
                whole = pa.RecordBatch.from_arrays([told[c] if c in told else pa.nulls(len(out), kinds[c]) for c in columns], names=columns)
                yield from (whole.slice(i, 10_000) for i in range(0, len(whole), 10_000))
