import itertools
import re

import pytest
from pyspark.sql import functions as F

from lorespark.llm import conversation_repair as cr

GRAMMAR = re.compile("(s?(ua)+)?")
BEGINNING = re.compile("s?(ua)*u?")


def all_repairs(symbols):
    """Every edit sequence of up to two inserts between reads: the least (cost, labels), by trying all."""
    n = len(symbols) // 2
    best = None

    def walk(i, inserts, roles, cost, labels):
        nonlocal best
        if best and cost > best[0] or not BEGINNING.fullmatch(roles):
            return
        if i == n and GRAMMAR.fullmatch(roles):
            best = min(best or (cost, labels), (cost, labels))
        if inserts < 2:
            for r in "ua":
                walk(i, inserts + 1, roles + r, cost + 5, labels + "I")
        if i < n:
            role, fault = symbols[2 * i : 2 * i + 2]
            walk(i + 1, 0, roles, cost + 2, labels + "D")
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                walk(i + 1, 0, roles + role, cost + more, labels + "K")
                for r in "ua":
                    walk(i + 1, 0, roles + r, cost + more + 1, labels + "R")

    walk(0, 0, "", 0, "")
    return best


def test_cheapest_against_all_edits():
    for n in range(4):
        for symbols in itertools.product([r + f for r in "suax" for f in "-tb"], repeat=n):
            symbols = "".join(symbols)
            assert cr.cheapest(symbols)[:2] == all_repairs(symbols), symbols


def test_longer_ones_and_what_is_written():
    for symbols in ("s-u-u-a-u-", "u-utatu-", "a-a-a-a-", "u-s-s-a-utat", "x-x-x-x-x-"):
        cost, labels, made = cr.cheapest(symbols)
        assert (cost, labels) == all_repairs(symbols), symbols
        assert GRAMMAR.fullmatch("".join((role or {"s": "s", "u": "u", "a": "a"}[symbols[2 * row]])[0] for row, role in made))


def test_a_long_conversation_takes_linear_time():
    cost, labels, made = cr.cheapest("u-a-" * 20_000 + "u-")
    assert (cost, len(labels), len(made)) == (2, 40_001, 40_000)
    assert labels.count("D") == 1


def test_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "assistant", " \t"), (1, 4, "assistant", "Hello!\n"), (1, 7, "user", "And"),
        (2, None, "user", "First."), (2, 5, "assistant", None), (None, None, None, "x."), (3, 1, "user", ""),
        (4, -(1 << 63), "user", "A."), (4, (1 << 63) - 1, "assistant", "B."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash"))
    out = {r["conv_id"]: r for r in cr.conversation_repair(df).collect()}
    one = out[1]
    assert [t["fault"] for t in one["turns"]] == ["-", "-", "d", "b", "-", "t"]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (3, 1, 1, 1, 2)
    assert (one["cost"], one["audit"]) == (6, "KKDDKD")
    assert [tuple(t) for t in one["repaired"]] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello!\n")]
    assert [t["text"] for t in out[2]["turns"]] == ["First.", " "] and out[2]["audit"] == "DD" and out[2]["gaps"] == 0
    assert out[None]["turns"][0]["role"] == " " and out[None]["audit"] == "D" and out[None]["gaps"] == 0
    assert out[3]["blank"] == 1 and out[3]["repaired"] == []
    assert out[4]["gaps"] == (1 << 63) - 1 and out[4]["audit"] == "KK"


def test_absent_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in cr.conversation_repair(df, present=F.col("conv_id") == 2).collect()}
    assert (out[1]["turns"], out[1]["cost"], out[1]["audit"], out[1]["illegal"]) == ([], 0, "", 0)
    assert out[2]["audit"] == "KK"
    assert cr.conversation_repair(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    text = "word " * 200_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "end.")], "conv_id long, turn long, role string, text string")
    row = cr.conversation_repair(df).first()
    assert row["truncated"] == 1 and row["cost"] == 4
    assert row["audit"] == all_repairs("uta-")[1]


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", None]), rnd.choice(["A.", "b", "", " ", "C!", None])) for c in range(60) for t in range(rnd.randrange(1, 6))]
    out = cr.conversation_repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in out:
        seen, symbols = set(), ""
        for t in r["turns"]:
            last = t["text"].strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "b" if not last else "d" if (t["role"], t["text"]) in seen else "t" if last not in ".!?" else "-"
            seen.add((t["role"], t["text"]))
            assert t["fault"] == fault
            symbols += (t["role"][0] if t["role"][0] in "sua" else "x") + fault
        assert (r["cost"], r["audit"]) == all_repairs(symbols)
