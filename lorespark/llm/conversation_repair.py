"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed lazily: the input acceptor, which reads a conversation's rows in
order; the edit transducer, which keeps a row, gives it another role, deletes it or inserts an
empty turn, each at a cost; and the role grammar ``(s?(ua)+)?``. A state is (rows read, inserts
since the last read, grammar state); only states that can be reached are made. A cheapest path
holds no grammar state twice between two reads, which bounds the inserts and leaves no cycle, so
states have a topological order. In its reverse, each state takes the least (cost, label string)
over its arcs: a label has one character, so the least string after an arc is that of its target.
Strings are compared by the rank that each target's string has among those of its own number of
rows read, so a conversation of n rows takes time and memory in proportion to n.

Spark orders rows, finds faults and builds the repaired turns; the path depends on roles and
faults alone, two characters a row, which is all that goes to Python, and equal ones are solved once a task.

Order: by turn, nulls first, then role, then text. A null role or text counts as one space. Each
row has at most one fault, the first that fits: ``blank`` (no character but white space),
``duplicate`` (an earlier row has the same role and text), ``truncated`` (the last character that
isn't white space doesn't end a sentence). Blank and duplicate rows have to go; a truncated row
that stays costs ``TRUNCATED`` more. A role that starts with none of s, u, a can't be kept. A null
conversation id is a conversation. Repeated rows are duplicates. An empty table gives an empty one.
A conversation is one row of output, so its own turns, and no others, are gathered in one place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; a truncated row that stays adds its own.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The role grammar: (state, initial) to state, and where it may end. A state is the last initial.
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FINAL = {"", "a"}
ROLES = {"u": "user", "a": "assistant"}
MAX_INSERTS = len({g for g, _ in GRAMMAR}) - 1
WHITE = " \t\n\x0b\x0c\r"

State = tuple[int, int, str]


def edits(initial: str, fault: str) -> Iterator[tuple[str, int, str]]:
    """The edit transducer's arcs that read a row: label, cost and the initial that is written, none where the row goes."""
    yield "D", DELETE, ""
    if fault not in ("b", "d"):
        stays = TRUNCATED if fault == "t" else 0
        yield "K", stays, initial
        for other in ROLES:
            yield "R", stays + REROLE, other


def arcs(symbols: str, state: State) -> Iterator[tuple[str, int, State]]:
    """The composed machine's arcs from a state: label, cost, target."""
    i, inserts, role = state
    if 2 * i < len(symbols):
        for label, cost, initial in edits(symbols[2 * i], symbols[2 * i + 1]):
            after = role if label == "D" else GRAMMAR.get((role, initial))
            if after is not None:
                yield label, cost, (i + 1, 0, after)
    if inserts < MAX_INSERTS:
        for initial in ROLES:
            if (after := GRAMMAR.get((role, initial))) is not None:
                yield "I", INSERT, (i, inserts + 1, after)


@functools.lru_cache(maxsize=20_000)
def cheapest(symbols: str) -> tuple[int, str, list[tuple[int, str | None]]]:
    """Cost, labels and the turns that are written: each one's row (-1: an inserted turn) and its new role (None: the row's own).

    ``symbols`` has two characters a row: the initial of its role and its fault.
    """
    n = len(symbols) // 2
    reached: list[dict[State, None]] = [{} for _ in range(n + 1)]
    reached[0][0, 0, ""] = None
    for i in range(n + 1):
        waiting = list(reached[i])
        while waiting:
            for _, _, target in arcs(symbols, waiting.pop()):
                if target not in reached[target[0]]:
                    reached[target[0]][target] = None
                    if target[0] == i:
                        waiting.append(target)
    chosen: list[dict[State, tuple]] = []
    after: dict[State, tuple[int, int]] = {}
    for i in range(n, -1, -1):
        here: dict[State, tuple] = {}
        for state in sorted(reached[i], reverse=True):
            found = [(0, (), "", None)] if i == n and state[2] in FINAL else []
            for label, cost, target in arcs(symbols, state):
                if target in here:
                    found.append((cost + here[target][0], (label, *here[target][1]), label, target))
                elif target in after:
                    found.append((cost + after[target][0], (label, after[target][1]), label, target))
            if found:
                here[state] = min(found)
        rank = {key: r for r, key in enumerate(sorted({x[1] for x in here.values()}))}
        after = {state: (x[0], rank[x[1]]) for state, x in here.items()}
        chosen.append({state: x[2:] for state, x in here.items()})
    chosen.reverse()
    state, labels, made = (0, 0, ""), [], []
    while (step := chosen[state[0]][state])[1] is not None:
        label, state = step
        labels.append(label)
        if label != "D":
            made.append((-1 if label == "I" else state[0] - 1, None if label == "K" else ROLES[state[2]]))
    return after[0, 0, ""][0], "".join(labels), made


def _repaired(symbols: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cheapest(s) for s in symbols], columns=["cost", "audit", "made"])


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def _count(turns: Column, fault: str) -> Column:
    return F.size(F.filter(turns, lambda t: t["fault"] == fault)).cast("bigint")


def conversation_repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """For each conversation ``conv_id, turns, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    ``turns`` are the rows in order with their faults, ``repaired`` the turns (role, text) after the cheapest edits,
    whose initials are ``audit``. ``gaps`` counts the turn numbers that are missing between the least and the greatest.
    Rows for which ``present`` isn't true count as absent, though their conversation is returned.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
    )
    # dealt by conversation once; window and grouping below keep that
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn"))
    rows = rows.repartition("conv_id").withColumns({"seen": seen, "end": F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))})
    fault = F.when(F.col("end") == "", "b").when(F.col("seen") > 1, "d").when(~F.col("end").isin(".", "!", "?"), "t").otherwise("-")
    turn = F.when(F.col("present"), F.struct("turn", "role", "text", "seen", fault.alias("fault")))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # a role without characters is none of the grammar's
    symbol = F.transform("turns", lambda t: F.concat(F.when(_initial(t["role"]).isin("s", "u", "a"), _initial(t["role"])).otherwise("x"), t["fault"]))
    out = out.withColumn("symbols", F.array_join(symbol, ""))
    solve = F.pandas_udf(_repaired, "cost long, audit string, made array<struct<row:int,role:string>>")
    out = out.withColumn("best", solve("symbols"))
    turn = lambda e: F.get("turns", F.greatest(e["row"], F.lit(0)))
    repaired = F.transform("best.made", lambda e: F.struct(F.coalesce(e["role"], turn(e)["role"]).alias("role"), F.when(e["row"] < 0, "").otherwise(turn(e)["text"]).alias("text")))
    pair = lambda i: F.concat(_initial(F.get("turns", i - 1)["role"]), _initial(F.get("turns", i)["role"]))
    pairs = F.when(F.size("turns") > 1, F.sequence(F.lit(1), F.size("turns") - 1)).otherwise(F.array().cast("array<int>"))
    illegal = F.size(F.filter(pairs, lambda i: ~pair(i).isin("su", "ua", "au"))).cast("bigint")
    places = F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull()))
    gaps = F.array_max("places").cast("decimal(20,0)") - F.array_min("places") + 1 - F.size("places")
    most = F.lit((1 << 63) - 1)
    out = out.withColumn("places", places)
    return out.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["turn"], t["role"], t["text"], t["fault"])).alias("turns"),
        F.when(F.size("places") == 0, 0).otherwise(F.least(gaps, most)).cast("bigint").alias("gaps"),
        _count(F.col("turns"), "b").alias("blank"), _count(F.col("turns"), "d").alias("duplicate"), _count(F.col("turns"), "t").alias("truncated"),
        illegal.alias("illegal"), "best.cost", "best.audit", repaired.alias("repaired"),
    )
