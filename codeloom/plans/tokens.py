"""Lexical scan of module code: tokens, bracket groups, calls and routines as rows.

A module is one row. Its text becomes tokens by one pattern, in which a string runs on over line ends where the next line
begins with ``|``, so what a line means needs no state from the lines above it. Lines, depths of brackets, statements and the
routine around a token are running sums and last values over arrays of tokens (``marks``), many modules at a time; no row
of a line or token is moved or sorted. What a question asks for leaves the pass as rows, for joins and aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marks import TYPES
from .settle import settle

NAME = r"[\p{L}_][\p{L}\p{N}_]*"
INDEX = r"""(?:\[[^\[\]()"';]*\])*"""
# The keywords of the language, and those that tell whether the result of a call is used.
KEYWORDS = """процедура конецпроцедуры функция конецфункции экспорт перем знач если тогда иначеесли иначе конецесли пока для каждого из по цикл конеццикла
возврат прервать продолжить попытка исключение конецпопытки вызватьисключение новый и или не истина ложь неопределено null ждать асинх
procedure endprocedure function endfunction export var val if then elsif else endif while for each in to do enddo
return break continue try except endtry raise new and or not true false undefined await async""".split()
_KEYWORDS = frozenset(KEYWORDS)
EXPRESSION = ["возврат", "если", "иначеесли", "или", "и", "не", "пока", "для", "из", "по", "ждать", "асинх"]
STATEMENT = ["тогда", "иначе", "цикл", "попытка", "исключение", "конецесли", "конеццикла", "конецпопытки", "прервать", "продолжить", "конецпроцедуры", "конецфункции"]
CONDITION = ["тогда", "цикл", "и", "или", "ждать"]
BINARY = ["=", "+", "-", "*", "/", "%", "(", "[", ",", "<", ">", "<=", ">=", "<>", "?"]
BLOCK_END = ["конецпроцедуры", "конецфункции", "конецесли", "конеццикла", "конецпопытки", "иначе", "иначеесли", "исключение", "endprocedure", "endfunction", "endif", "enddo", "endtry", "else", "elsif", "except"]
HEADS, ENDS = ["процедура", "функция", "procedure", "function"], ["конецпроцедуры", "конецфункции", "endprocedure", "endfunction"]
NEW, RETURN, VARIABLE, EXPORT, BY_VALUE = ["новый", "new"], ["возврат", "return"], ["перем", "var"], ["экспорт", "export"], ["знач", "val"]
BEGINS = [*STATEMENT, *EXPORT, "then", "else", "do", "try", "except", "endif", "enddo", "endtry"]
#: Methods that give an object of the type of their own; fixed values.
COPIES = ("скопировать", "создать", "copy", "create")
#: Places of a token: its line and, below that, its number in the line.
LINE = 1 << 20


@cache
def letters() -> tuple[str, str]:
    """Signs that a name begins with: the usual ones, and all."""
    numbers = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
    return "[A-Za-z_ЁА-яё]", rf"[^\W\d{numbers}]"


@cache
def _name(rest: str) -> re.Pattern:
    return re.compile(rf"(?:{'|'.join(letters())})\w*" if not rest else rf"\.?((?:{'|'.join(letters())})\w*){rest}")


def names_of(text: str) -> list[str]:
    """The names in a chain, in its indexes too."""
    return [text] if text.isidentifier() and text.isascii() else _name("").findall(text)


def named(text: str) -> tuple[str, str | None, str]:
    """A callee without blanks, what stands before its last name, and that name without an index."""
    callee = "".join(text.split()) if not text.isalnum() else text
    found = _name(INDEX + "$").search(callee)
    return (callee, callee[: found.start()] or None, found[1]) if found else (callee, callee or None, "")


def copied(text: str) -> str | None:
    """The variable of which a call by this chain makes a copy."""
    parts = "".join(text.split()).split(".")
    return parts[0].lower() if len(parts) == 2 and parts[1].lower() in COPIES and "[" not in text else None


@cache
def signs() -> re.Pattern:
    """Tokens, comments and line ends of a text. A chain of names by dots and plain indexes is one token; a string that is
    open at a line end goes on where the next line begins with ``|``. Letters and numbers are those of Unicode; a number
    sign that is no digit, such as a square, begins no name. The usual letters are tried first, as that set is slow."""
    usual, other = letters()
    index, blank = r"""(?:\[[^\[\]()"';\r\n]*+\])*+""", r"[ \t\x0b\f]*+"
    chain = rf"\w*+{index}(?:{blank}\.{blank}(?:{usual}|{other})\w*+{index})*"
    string = r'"[^"\r\n]*+(?:(?:""|(?:\r\n|\r|\n)[ \t]*+\|)[^"\r\n]*+)*+"?'
    rest = r"[^\r\n\x85\u2028\u2029]*+"
    number, operator = "[0-9]++(?:,[0-9]+)?(?:[eE][+-]?[0-9]+)?", r"[-+*%=()\[\],.;?:~]|<=|>=|<>|[<>]"
    return re.compile(rf"[ \t]*+({usual}{chain}|\n|{operator}|{number}|{string}|\r\n?|'[^'\r\n]*+'?|//{rest}|/|#{rest}|&\w*+|{other}{chain}|[^ \t\n\x0b\f\r\xa0\ufeff])")


def plain_tokens(texts: DataFrame) -> DataFrame:
    """``path, n, at, total, text, kind`` of every token but comments. Kinds: ``k`` keyword, ``c`` name or chain of
    names by dots and plain indexes, ``o`` operator, ``l`` string, date or number, ``d`` directive, ``a`` annotation, ``x``
    any other sign. A string over several lines is one token a line."""
    return marked_tokens(dealt(texts), ["path", "n", "at", "total", "text", "kind"])


def token_lines(texts: DataFrame) -> DataFrame:
    """``path, n, total, tokens array<struct<text, kind>>`` of every line that has a token, comments left out."""
    return marked_tokens(dealt(texts), ["path", "n", "total", "tokens"], "line")


def dealt(texts: DataFrame) -> DataFrame:
    """Modules ``(path, text)`` dealt to as many partitions as the session shuffles to, as few files may hold many."""
    return texts.select("path", "text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def kind_of(text: str, low: str) -> str:
    """The kind of a token, as in ``plain_tokens``."""
    first = text[0]
    if first in "-+*/%=<>()[],.;?:~":
        return "o"
    if first in "\"'0123456789":
        return "l"
    if first in "#&":
        return "d" if first == "#" else "a"
    if first.lower() != first.upper() or first == "_" or first.isalpha():
        return "k" if low in _KEYWORDS else "c"
    return "x"


def directive(low: str) -> str:
    """The word of a directive with its sign."""
    return low[: next((i for i, c in enumerate(low) if i and not (c.isalnum() or c == "_")), len(low))]


def marked_tokens(texts: DataFrame, columns: list[str], only: str | None = None) -> DataFrame:
    """Tokens of modules ``(path, text)`` with what a running sum or a last value tells, the stated ``columns`` of: ``block``
    (statements and headers begin a new one), ``level`` of brackets within it, ``routine`` and ``head_at`` (name and place of
    the header, null outside), whether the token stands right behind a return (``late``), in the statement of the header
    (``heading``), under a condition (``conditional``) or after ``Перем`` (``variable``), the tokens around it, ``given``, the
    name before ``=`` right before it, ``made``, the name and type of an object that is created up to it, ``argument``, its
    place where it is alone one, ``closing``, ``listed`` and ``until`` of a header (the end of its bracket, what stands in it,
    the line of the next header or end), ``tokens`` of its line, ``group`` (see ``Scan.groups``), and those of ``QUESTIONS``.
    ``only`` leaves out tokens that a question is not about.

    One pass over the texts as arrays (``marks``) gives all: no row of a line or token is moved or sorted, and only the
    columns and tokens of the question leave the pass.
    """
    return answered(texts, {only: columns}).select(*columns)


def answered(texts: DataFrame, questions: dict[str | None, list[str]]) -> DataFrame:
    """The rows of several questions by one pass, with the columns of all; ``asks`` says whose a row is."""
    columns = ["asks", *dict.fromkeys(c for of in questions.values() for c in of)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import marks, tokens

        return marks.marked(batches, tokens, questions, columns)

    return texts.select("path", "text").mapInArrow(run, ", ".join(f"`{c}` {TYPES[c]}" for c in columns))


def routine_rows(tokens: DataFrame) -> DataFrame:
    """``path, kind, name, is_export, start_line, end_line, parameters, total, required, body_line, body_at, head_at`` of every
    routine, and further columns of ``tokens``.

    A routine ends at the next end, at the keyword of the next header, or with the module. Names that repeat under a
    condition are one routine with the first, as long as the longest.
    """
    return tokens.select("path", "header.*", F.col("at").alias("head_at"), *[c for c in tokens.columns if c not in HEADER])


#: The columns of a question: headers of routines, calls, names that are assigned or declared, code behind a return, and
#: chains of names. ``TYPED`` says what assignments create, ``SOURCES`` has the last assignment of each variable and what calls
#: pass on, ``DRAFT`` says what routines and variables are not used.
HEADER = ["path", "at", "header"]
QUESTIONS = {
    "header": HEADER, "call": ["path", "routine", "at", "call"], "assigned": ["path", "routine", "head_at", "n", "at", "block", "target"], "late": ["path", "routine", "n"],
    "access": ["path", "routine", "n", "text"],
}
TYPED = {"assigned": [*QUESTIONS["assigned"], "type"]}
SOURCES = {"variable": ["path", "routine", "text", "type", "root"], "call": [*QUESTIONS["call"], "passed"]}
DRAFT = {"header": [*HEADER, "idle", "returns"], "assigned": [*QUESTIONS["assigned"], "idle"]}


class Scan:
    """Some modules ``(path, text)``. Each question takes its own columns of the marks of their tokens. The questions named in
    advance, by themselves or with their columns, are answered by one pass over the texts and settled; others take a pass
    each. Texts and routines are settled when first asked for."""

    def __init__(self, texts: DataFrame, *asked: str, **columns: list[str]):
        self.given = texts
        self.asked = {x: QUESTIONS[x] for x in asked} | columns

    @cached_property
    def texts(self) -> DataFrame:
        return settle(dealt(self.given))

    @cached_property
    def answers(self) -> DataFrame:
        return settle(answered(self.__dict__.get("texts", dealt(self.given)), self.asked))

    def rows(self, only: str, columns: list[str]) -> DataFrame:
        """The rows of a question, from the settled answers where they have its columns."""
        if set(columns) <= set(self.asked.get(only, ())):
            return self.answers.where(F.col("asks") == only).select(*columns)
        return self.marked(columns, only)

    def marked(self, columns: list[str], only: str | None = None) -> DataFrame:
        return marked_tokens(self.texts, columns, only)

    @property
    def tokens(self) -> DataFrame:
        return self.marked([c for c in TYPES if c not in ("asks", "header", "idle", "returns", "call", "passed", "type", "root")])

    @property
    def groups(self) -> DataFrame:
        """A row for each opening bracket: what stands before it, how many values stand in it, what follows its end, and whether
        it stands in the arguments of a call.

        Of the brackets of a level in a statement, the next one after an opening must close it. Running counts of commas and
        values over a level differ between an opening and its end by what stands between; a bracket inside one is a value of
        the outer group too.
        """
        return self.marked(["path", "at", "routine", "group"], "group").select("path", "at", "routine", "group.*")

    @cached_property
    def routines(self) -> DataFrame:
        found = routine_rows(self.rows("header", self.asked.get("header", HEADER)))
        return found if "header" in self.asked else settle(found)

    def calls(self) -> DataFrame:
        """``path, routine, line, callee, qualifier, method, args, used, nested, at`` of every call, from the line of its first name.

        ``args`` is -1 where the bracket never closes; ``used`` tells whether the result is used: false where the call is the
        statement, null where that is not clear. ``nested`` calls stand in the arguments of another call. Names after ``Новый``
        and keywords are no calls. What follows a closing bracket by a dot is a call without qualifier.
        """
        return self.rows("call", QUESTIONS["call"]).select("path", "routine", "call.*", "at")

    def assigned(self) -> DataFrame:
        """``path, routine, head_at, name, line, at, variable`` of names that begin a statement before ``=``, that a loop runs
        over, or that stand after ``Перем`` (``variable``)."""
        return self.rows("assigned", QUESTIONS["assigned"]).select("path", "routine", "head_at", "target.name", F.col("n").alias("line"), "at", "target.variable")

    def read(self) -> DataFrame:
        """``path, routine, head_at, name`` of names that are read in bodies: not members after a dot, not targets."""
        t = self.marked(["path", "at", "routine", "head_at", "text"], "read").where("head_at is not null")
        body = t.join(self.routines.select("path", "head_at", "body_at"), ["path", "head_at"]).where("at > body_at")
        names = F.regexp_extract_all("text", F.lit(rf"(?<![\p{{L}}\p{{N}}_.])({NAME})"), F.lit(1))
        return body.select("path", "routine", "head_at", F.explode(names).alias("name"))

    def names(self) -> DataFrame:
        """``path, routine, head_at, n, name`` of every name in code, headers, members of chains and names in indexes too."""
        return self.marked(["path", "routine", "head_at", "n", "text"], "name").select("path", "routine", "head_at", "n", F.explode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("name"))
