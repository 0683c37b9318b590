"""Added spans: planted loose shapes with their context against decoys of the same shapes."""

import random

from codeloom.llm import pii


def test_added_spans_by_kind(spark):
    rng = random.Random(41)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    key = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    words = lambda: " ".join(rng.choices("river stone green walk paper light under often seven".split(), k=rng.randint(4, 12)))
    loose = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    rows, want, never = [], set(), set()

    def put(doc, before, span, after, kind, sure):
        text = f"{words()} {before}{span}{after} {words()}"
        at = text.index(span)
        rows.append((doc, text))
        (want if sure else never).add((doc, kind, at, at + len(span)))

    for n in range(240):
        kind = n % 6
        if kind == 0:
            put(n, rng.choice(["call ", "phone: ", "tel. "]), loose(), ".", "phone", True)
        elif kind == 1:
            put(n, rng.choice(["section ", "page ", "figure "]), loose(), ".", "phone", False)
        elif kind == 2:
            put(n, rng.choice(["export ", "config "]), f'{rng.choice(["api_key", "auth_token", "password"])} = "{key(24)}"', ";", "secret", True)
        elif kind == 3:
            put(n, "build ", f'{rng.choice(["color", "layout", "chapter"])} = "{key(24)}"', ";", "secret", False)
        elif kind == 4:
            rows.append((n, f"write to {key(6)}@{key(5)}.com now {words()}"))
        else:
            rows.append((n, f"{words()} version 3.{n % 256}.1.2 {words()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, *s.split(":")) for r in pii.detect(df).select("doc_id", pii.joined("spans").alias("s")).collect() for s in r.s.split(",") if s}
    found = {(d, k, int(a), int(b)) for d, k, a, b in found}
    for kind in ("phone", "secret"):
        planted, decoys = {w for w in want if w[1] == kind}, {w for w in never if w[1] == kind}
        recall, wrong = len(planted & found) / len(planted), len(decoys & found)
        precision = len(planted & found) / max(1, len(planted & found) + wrong)
        print(kind, "recall", recall, "precision", precision)
        assert recall >= 0.9 and precision >= 0.9
    assert sum(f[1] == "email" for f in found) == 40
