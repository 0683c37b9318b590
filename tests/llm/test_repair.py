"""Repair of conversations against the SQL of the query and against plain search over (cost, edits)."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from codeloom.llm import queries, repair

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(roles, faults):
    """(cost, edits) by dynamic programming forward; states: what was written last."""
    best = {"": (0, "")}

    def relax(now):
        for _ in range(3):
            for last in list(now):
                to = "a" if last == "u" else "u"
                cost, edits = now[last]
                now[to] = min(now.get(to, (1 << 60, "")), (cost + 3, edits + "I"))
        return now

    for role, fault in zip(roles, faults, strict=True):
        then = {}
        for last, (cost, edits) in relax(best).items():
            ways = [(last, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = "a" if last == "u" else "u"
                ways.append((to, 3 + more, "R"))
                if role[:1] == to or (role[:1] == "s" and last == ""):
                    ways.append((role[:1], more, "K"))
            for to, c, letter in ways:
                then[to] = min(then.get(to, (1 << 60, "")), (cost + c, edits + letter))
        best = then
    relax(best)
    return min(best.get("", (1 << 60, "")), best.get("a", (1 << 60, "")))


def plain(rows, hurt=True):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        given[conv]
        role, text = " " if role is None else role, " " if text is None else text
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(said.encode()) % 20 if hurt else 9
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        given[conv] += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = []
    for conv, own in given.items():
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own if r[0]}
        cost, audit = cheapest([r[2] for r in own], faults)
        lines, last, i = [], "", 0
        for letter in audit:
            to = "a" if last == "u" else "u"
            if letter == "K":
                lines.append(f"{own[i][2]}:{own[i][3]}")
                last = own[i][2][0]
            elif letter != "D":
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[to]}:{own[i][3] if letter == 'R' else ''}")
                last = to
            i += letter != "I"
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", None, "", "S", "user"]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "So. \x0b\n", "é", "Why?\xa0", "fine."]
    rows = []
    for conv in range(160):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.random()}."))
    rows += [r for r in rows if rng.random() < 0.1]
    rows += [(None, t, rng.choice(roles), f"{t}.") for t in (3, None, 5, 2, 2)]
    rows += [(10**15, t, rng.choice(["system", "user", "assistant"]), rng.choice(["One.", "two", f"{t}!", f"{t}"])) for t in range(400)]
    rows += [(10**15 + 1, 4, "user", "Again.")] * 300
    return rows


def frame(spark, rows):
    wide = [(*r, 7, "x", 3, "y", 1) for r in rows]
    return spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, n int, seg string, codes long, cost string, again int").repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)


@pytest.mark.parametrize("segment", [(1024, 1 << 20), (3, 1 << 20), (1024, 40)])
def test_equals_plain_search(spark, segment):
    rows = cases()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = collected(repair.repair(repair.damage(frame(spark, rows)), *segment))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == plain(rows)


def test_undamaged_rows_and_clean_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "user", "q?"), (3, 1, "assistant", "a."), (3, 2, "user", "u.")]
    from pyspark.sql import functions as F

    df = frame(spark, rows).withColumn("n", F.lit(1))
    got = collected(repair.repair(df))
    assert got == plain(rows, hurt=False)
    assert {r[0]: (r[6], r[7]) for r in got} == {1: (0, "KKK"), 2: (3, "KI"), 3: (6, "IKKI")}


def test_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in cases() if r[0] is None or r[0] < 10**15 + 1]
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "text"]), f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = sorted((tuple(r) for r in con.execute(queries.ORACLE_SQL["op11_repair"]).fetchall()), key=str)
    assert collected(queries.op11_repair(spark, str(tmp_path))) == want == plain(rows)


def test_no_rows(spark):
    assert collected(repair.repair(repair.damage(frame(spark, [])))) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert collected(repair.repair(repair.damage(frame(spark, [(gone, 0, "user", "x.")])))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
