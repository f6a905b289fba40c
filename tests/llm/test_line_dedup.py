import random
from collections import defaultdict

from lorespark.llm import line_dedup as ld


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute(rows, min_chars=20, min_docs=3):
    holds = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holds[k].append(d)
    lost = {k: max((x for x in v if x is not None), default=None) for k, v in holds.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_lines int").repartition(3)
    out = ld.line_dedup(df, **kw)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)


def rows_of(seed, n=80):
    rnd = random.Random(seed)
    pool = [f"line number {i} which is long enough é" for i in range(30)] + ["short", "", "é" * 20, "É" * 20, "é" * 19, "  \tLINE NUMBER 3 WHICH IS LONG ENOUGH é\r"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randrange(0, 9)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 1, rows[4][1]), (None, rows[5][1]), (5, rows[5][1]), rows[6], (n + 2, "x" * 50_000 + "\n" + pool[0])]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        assert run(spark, rows) == brute(rows)


def test_full_filters_stay_exact(spark):
    rows = rows_of(3)
    assert run(spark, rows, max_bits=1 << 6, min_docs=4) == brute(rows, min_docs=4)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, "a line that is long enough to count")] * 3) == [(None, 1, 0, "a line that is long enough to count")] * 3
