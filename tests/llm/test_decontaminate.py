import random
import re

from lorespark.llm import decontaminate as dc


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, tuple(w[j : j + window])) for j in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in wins:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    ids.add(i)
        ids.discard(None)
        out.append((d, len(w), len(hit), ",".join(sorted(map(str, ids))), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    out = dc.decontaminate(d, b, **kw)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in out.collect()), key=str)


def case(seed, short):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "THE", "ﬁ", "KelvinK"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([12, 15, 30] + short)))) for i in range(14)]
    docs = []
    for i in range(50):
        parts = [" ".join(rnd.choices(vocab, k=rnd.randrange(0, 30)))]
        for _ in range(rnd.randrange(3)):
            w = rnd.choice(items)[1].split(" ")
            a = rnd.randrange(len(w))
            parts.append(rnd.choice([" ", ", "]).join(x.upper() if x.isascii() else x for x in w[a : a + rnd.randrange(1, 40)]))
        docs.append((i, "; ".join(parts)))
    docs += [(50, None), (51, ""), (52, "?!"), docs[3], (None, docs[4][1]), (7, docs[5][1])]
    return docs, items + [(20, None), (21, "--"), (None, docs[9][1]), items[0], (22, items[0][1])]


def test_against_brute_force(spark):
    for seed, short in ((1, []), (2, [1, 2, 3, 5])):
        docs, items = case(seed, short)
        assert run(spark, docs, items) == brute(docs, items)


def test_without_broadcast(spark):
    docs, items = case(3, [2])
    rnd = random.Random(4)
    long = " ".join(rnd.choices([f"w{i}" for i in range(40)], k=20_000))
    docs += [(60, long), (61, f"{long} {items[2][1]} {long}")]
    assert run(spark, docs, items, broadcast_bytes=0) == run(spark, docs, items) == brute(docs, items)


def test_no_position_carries_its_text(spark, monkeypatch):
    """Beyond the broadcast bound, what a shuffle join by shingle takes has no array of words."""
    plans = []
    real = dc.materialize

    def seen(df, name):
        if name in ("shingle-counts", "candidates"):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(dc, "materialize", seen)
    docs, items = case(3, [])
    run(spark, docs[:5], items, broadcast_bytes=0)
    assert len(plans) == 2
    for plan in plans:
        join = next(x for x in plan.split("\n") if "Join Inner" in x)
        side = plan.split("\n")[plan.split("\n").index(join) + 1]
        assert "Project [" in side and not re.search(r"(?:\[|, )w#\d+(?:,|\])", side), side


def test_empty(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b"), (2, None)], []) == [(1, 2, 0, "", False), (2, 0, 0, "", False)]


def test_clean_documents_keep_their_columns(spark):
    d = spark.createDataFrame([(1, "a b c", "s"), (2, "x y z", None)], "doc_id long, text string, source string")
    b = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert [tuple(r) for r in dc.clean_documents(d, b).collect()] == [(2, "x y z", None)]
