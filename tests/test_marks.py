"""Marks of tokens: modules stay whole over batches, and no row of a token is sorted or moved for a question."""

import pyarrow as pa

from codeloom.plans import marks, tokens

CODE = "Процедура П(А)\n  Ф(А, Г(1));\n  Х = Новый Массив;\nКонецПроцедуры"


def test_modules_stay_whole_over_batches():
    paths = ["a"] * 3 + ["b"] * 7 + ["c"]
    batches = pa.table({"path": paths, "n": list(range(11))}).to_batches(max_chunksize=2)
    got = [t.column("path").to_pylist() for t in marks.whole_modules(iter(batches), some=2)]
    assert sum(got, []) == paths
    assert all(set(x).isdisjoint(y) for i, x in enumerate(got) for y in got[i + 1 :])


def test_questions_sort_no_tokens(spark):
    scan = tokens.Scan(spark.createDataFrame([("m", CODE), ("o", CODE)], "path string, text string"))
    calls = scan.calls()
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert sorted((r.path, r.method, r.args, r.nested) for r in calls.collect()) == [(p, *x) for p in "mo" for x in (("Г", 1, True), ("Ф", 2, False))]
    assert scan.marked(["path", "made"], "made").selectExpr("path", "made.name", "made.type").sort("path").collect() == [("m", "Х", "Массив"), ("o", "Х", "Массив")]


def test_questions_move_no_lines(spark):
    """Lines and tokens are made in the pass over the texts: no window, no sort and no row of a line before it."""
    text = 'А = "раз\r\n  |два "" три\r\n|"; ²Б[1].В(1e5);\r\n\r\n// "\r\n#Если Ф("'
    df = spark.createDataFrame([("m", text), ("none", None), ("empty", "")], "path string, text string")
    for found in (tokens.plain_tokens(df), tokens.token_lines(df), tokens.routine_rows(tokens.Scan(df).marked(tokens.HEADER, "header")).drop("end_line", "conditional")):
        before = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
        assert not any(x in before for x in ("Window", "Generate", "Sort "))
    got = [(r.n, r.at % tokens.LINE, r.total, r.text, r.kind) for r in tokens.plain_tokens(df).sort("at").collect()]
    assert got == [
        (1, 0, 6, "А", "c"), (1, 1, 6, "=", "o"), (1, 2, 6, '"раз', "l"), (2, 0, 6, '"  |два "" три', "l"), (3, 0, 6, '"|"', "l"), (3, 1, 6, ";", "o"), (3, 2, 6, "²", "x"),
        (3, 3, 6, "Б[1].В", "c"), (3, 4, 6, "(", "o"), (3, 5, 6, "1e5", "l"), (3, 6, 6, ")", "o"), (3, 7, 6, ";", "o"), (6, 0, 6, '#Если Ф("', "d"),
    ]
    assert [(r.n, [x.text for x in r.tokens]) for r in tokens.token_lines(df).where("n < 3").sort("n").collect()] == [(1, ["А", "=", '"раз']), (2, ['"  |два "" три'])]


def test_comment_heads_by_one_exchange(spark):
    from codeloom.operators import grep

    lines = grep.lines(spark.createDataFrame([("m", "// a\n&x\n\n// b\nF()\n  // c\nG() H()\n\n")], "path string, text string"))
    starts = spark.createDataFrame([("m", 5), ("m", 7), ("m", 7), ("m", 8), ("m", 6), ("m", 99)], "path string, n int")
    heads = grep.comment_heads(lines, starts)
    assert heads._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1
    assert sorted(tuple(r) for r in heads.collect()) == [("m", 5, "// a\n// b"), ("m", 6, ""), ("m", 7, "// c"), ("m", 7, "// c")]
