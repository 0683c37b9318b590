"""The token scan against a plain scanner that walks sign by sign, on modules made at random and by hand."""

import random

import pytest

from codeloom.plans import tokens


def scan(text):
    """(line, text, kind) of each token; names and dots are tokens of their own."""
    out, i, line = [], 0, 1
    word = lambda c: c.isalpha() or c.isdigit() or c == "_"
    while i < len(text):
        c, a, at = text[i], i, line
        if c == "\n":
            line += 1
            i += 1
            continue
        if c.isspace():
            i += 1
            continue
        if c == '"':
            i += 1
            while i < len(text):
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        i += 2
                        continue
                    i += 1
                    break
                if text[i] == "\n":
                    k = i + 1
                    while k < len(text) and text[k] in " \t":
                        k += 1
                    if text[k : k + 1] != "|":
                        break
                    line += 1
                i += 1
            out.append((at, text[a:i], "l"))
            continue
        if c == "'":
            i += 1
            while i < len(text) and text[i] not in "'\n":
                i += 1
            i += text[i : i + 1] == "'"
            out.append((at, text[a:i], "l"))
            continue
        if text[i : i + 2] == "//" or c == "#":
            while i < len(text) and text[i] != "\n":
                i += 1
            if c == "#":
                out.append((at, text[a:i], "d"))
            continue
        if c == "&":
            i += 1
            while i < len(text) and word(text[i]):
                i += 1
            out.append((at, text[a:i], "a"))
            continue
        if c.isdigit():
            while i < len(text) and text[i].isdigit():
                i += 1
            if text[i : i + 1] == "," and text[i + 1 : i + 2].isdigit():
                i += 1
                while i < len(text) and text[i].isdigit():
                    i += 1
            out.append((at, text[a:i], "l"))
            continue
        if word(c):
            while i < len(text) and word(text[i]):
                i += 1
            out.append((at, text[a:i], "k" if text[a:i].lower() in tokens.KEYWORDS else "c"))
            continue
        i += 2 if text[i : i + 2] in ("<=", ">=", "<>") else 1
        out.append((at, text[a:i], "o" if text[a] in "+-*/%=<>()[],.;?:~" else "x"))
    return out


def calls_of(text):
    """(line, callee, args, nested) by walking forward and skipping nothing."""
    t = [x for x in scan(text) if x[2] not in "da"]
    out, open_calls = [], []
    for i, (line, s, kind) in enumerate(t):
        if s == "(" and kind == "o" and i and t[i - 1][2] == "c" and t[i - 1][0] == line:
            k = i - 1
            while k >= 2 and t[k - 1][1] == "." and t[k - 2][2] == "c":
                k -= 2
            head = t[k - 1] if k else None
            depth, commas, filled, end = 0, 0, False, None
            for j in range(i, len(t)):
                x = t[j][1] if t[j][2] == "o" else ""
                if j > i and not (x == "," and depth == 1) and not (x in (")", "]") and depth == 1):
                    filled = True
                depth += (x in ("(", "[")) - (x in (")", "]"))
                commas += x == "," and depth == 1
                if not depth:
                    end = j
                    break
                if x == ";":
                    break
            if head and head[1].lower() in ("новый", "процедура", "функция"):
                continue
            nested = any(e is not None and i < e for e in open_calls)
            open_calls.append(end)
            out.append((t[k][0], "".join(x[1] for x in t[k:i]), commas + filled if end is not None else -1, nested))
    return sorted(out)


def module(rng):
    name = lambda: rng.choice(["Файл", "x", "Сумма_1", "М.Найти", "А . Б", "Док.Строки.Найти", "Если_Так"])

    def value(depth):
        return rng.choice([
            lambda: "1,5", lambda: '"a(b, ""c"" // d;"', lambda: "'2024(01'", lambda: name(), lambda: "(" + value(depth + 1) + " + 2)" if depth < 4 else "3",
            lambda: call(depth + 1) if depth < 4 else "x", lambda: call(depth + 1) if depth < 4 else "x", lambda: "Новый Массив(" + value(depth + 1) + ")" if depth < 4 else "x", lambda: '"раз\n  |два (" + 1',
        ])()

    def call(depth):
        gap = rng.choice([", ", ",\n   ", ", // why (not\n  "])
        return name() + rng.choice(["(", "( ", "(\n "]) + gap.join(value(depth) for _ in range(rng.randint(0, 3))) + rng.choice([")", "\n )"])

    def statement():
        return rng.choice([
            lambda: call(0) + ";", lambda: "X = " + value(0) + ";", lambda: "Если " + call(0) + " = 1 И Не " + call(0) + " Тогда\n " + call(0) + ";\n КонецЕсли;", lambda: call(0) + ".Метод(" + value(0) + ");",
            lambda: "// comment \"( ' #", lambda: "#Если Сервер Тогда // \"", lambda: "#КонецЕсли", lambda: 'Т = "open (\nF(1);', lambda: "a = 1; " + call(0) + "; b = 2;", lambda: "Знач\n.Имя(1);", lambda: "Цепь\n  .Звено\n  .Конец(2);", lambda: "|", lambda: "",
        ])()

    return "\n".join(statement() for _ in range(rng.randint(3, 25)))


def test_calls_equal_a_plain_scanner(spark):
    rng = random.Random(17)
    texts = {f"m{i}": module(rng) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "path string, text string").repartition(4)
    found = {p: [] for p in texts}
    s = tokens.Scan(df)
    for r in s.calls().collect():
        found[r.path].append((r.line, r.callee, r.args, r.nested))
    for p, text in texts.items():
        assert sorted(found[p]) == calls_of(text), (text, p)
    words = {p: [] for p in texts}
    for r in s.tokens.select("path", "n", "at", "text", "kind").collect():
        words[r.path].append((r.n, r.kind, r.at, r.text))
    for p, text in texts.items():
        # Strings over lines are one token a line; chains are compared name by name.
        got = [(n, k) for n, k, _, t in sorted(words[p], key=lambda w: w[2]) for _ in ([0] if k != "c" else __import__("re").findall(r"\w+", t))]
        want = [(n + i, k) for n, t, k in scan(text) if t != "." for i in range(t.count("\n") + 1)]
        assert [g for g in got if g[1] in "kclda"] == [w for w in want if w[1] in "kclda"], text


MODULE = """// голова "(
#Если Сервер Тогда
&НаСервере
Функция Первая(А, // первый, параметр
    Знач Б = Новый_Имя, а = -1, В = "x,y") Экспорт
    Перем Счет,
        Лишний;
    Счет = Вторая(А).Свойство;
    Для Каждого Строка Из Данные.Строки Цикл
        Возврат Счет; Мимо();
    КонецЦикла;
КонецФункции
КонецПроцедуры
#Иначе
Функция ПЕРВАЯ(А) Экспорт
    Возврат 1;

КонецФункции
#КонецЕсли
Процедура Вторая
    Пока Истина Цикл Х = 1; КонецЦикла;
Асинх Функция Третья() Возврат 2; КонецФункции
Процедура Открытая(
Процедура Конец_() Экспорт
    Лишний = '20240101';
"""


@pytest.fixture(scope="module")
def by_hand(spark):
    return tokens.Scan(spark.createDataFrame([("m", MODULE), ("empty", ""), ("none", None), ("bom", "﻿Процедура А() КонецПроцедуры")], "path string, text string"))


def test_routines(by_hand):
    rows = sorted((r.start_line, r.kind, r.name, r.is_export, r.end_line, ",".join(r.parameters), r.total, r.required) for r in by_hand.routines.where("path = 'm'").collect())
    assert rows == [
        (4, "Function", "Первая", True, 18, "А,Б,В", 3, 1), (20, "Procedure", "Вторая", False, 22, "", 0, 0), (22, "Function", "Третья", False, 22, "", 0, 0), (24, "Procedure", "Конец_", True, 26, "", 0, 0),
    ]
    assert [r.name for r in by_hand.routines.where("path = 'bom'").collect()] == ["А"]


def test_assigned_and_used(by_hand):
    rows = sorted((r.line, r.routine, r.name, r.variable) for r in by_hand.assigned().collect())
    assert rows == [(6, "Первая", "Счет", True), (7, "Первая", "Лишний", True), (8, "Первая", "Счет", False), (9, "Первая", "Строка", False), (21, "Вторая", "Х", False), (25, "Конец_", "Лишний", False)]
    assert sorted((r.line, r.callee, r.used) for r in by_hand.calls().collect()) == [(8, "Вторая", True), (10, "Мимо", False)]
