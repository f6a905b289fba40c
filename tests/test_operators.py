import math
import random

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import docs, index, retrieval, session, store, study
from lorespark.streaming import jobs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text_scalars(spark):
    assert one(spark, tx.normalise_question(F.lit("  What  IS\tthe a , b? "))) == "what is the a  b"
    assert one(spark, tx.question_terms(F.lit("What is the zebra and the apple, apple?"))) == "apple apple zebra"
    assert one(spark, F.octet_length(tx.question_terms(F.lit("é" * 150)))) == 200
    assert one(spark, tx.tokens(F.lit("Spark 引擎测试 x"))) == ["spark", "引擎", "擎测", "测试", "x"]
    assert one(spark, tx.key_phrases(F.lit("北京的标准是什么 Spark engine"))) == ["北京", "Spark", "engine"]
    assert one(spark, tx.strip_think(F.lit("a<think>b</think>c</think> <think>d"))) == "ac</think>"
    assert one(spark, tx.json_from_noise(F.lit('x ```json\n{"a": [1]}\n``` y'))) == '{"a": [1]}'
    assert one(spark, tx.json_from_noise(F.lit("none"))) is None
    assert [one(spark, tx.file_format(F.lit(n))) for n in ("a.b.DOCX", "x", "y.md", "z.zip")] == ["word", "other", "markdown", "other"]
    assert [one(spark, tx.line_range(F.lit("a\nb\nc"), F.lit(a), F.lit(b))) for a, b in ((0, 2), (2, 9), (3, 2), (4, 5))] == ["a\nb", "b\nc", "", ""]


def test_lines_lose_spaces_only_when_trimmed(spark):
    assert one(spark, tx.first_paragraph(F.lit("0 a 0\n1 b 1\n  # head\n 3 "))) == "0 a 0\n1 b 1\n3\n"
    assert one(spark, docs.is_contents(F.lit("x"), F.lit("  - [a](#a)\n 1 \n  - [b](#b)\n- [c](#c)")))


def test_parent_by_window_equals_a_stack(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for s in range(30):
        stack = []
        for n in range(1, rnd.randrange(2, 30)):
            level = rnd.randrange(1, 5)
            while stack and stack[-1][1] >= level:
                stack.pop()
            want[s, n] = stack[-1][0] if stack else None
            stack.append((n, level))
            rows.append((s, n, level, "t"))
    heads = spark.createDataFrame(rows, "source_id long, line_no long, level long, title string")
    totals = heads.groupBy("source_id").agg((F.max("line_no") + 3).alias("total_lines"))
    got = {(r["source_id"], r["line_start"]): r["parent_line"] for r in docs.outline(heads, totals).collect()}
    assert got == want


def test_windows_cover_and_respect_code(spark):
    rnd = random.Random(2)
    body = []
    for _ in range(40):
        body += rnd.choice([["# head", ""], ["```", "code", "", "more", "```"], ["| a | b |"] * 4, ["text " * rnd.randrange(1, 30)], [""]])
    rows = [r for r in docs.windows(spark.createDataFrame([(1, "\n".join(body)), (2, ""), (3, None)], "source_id long, text string"), 500).collect()]
    mine = sorted((r["line_start"], r["line_end"]) for r in rows if r["source_id"] == 1)
    assert {i for a, b in mine for i in range(a, b + 1)} == set(range(1, len(body) + 1))
    assert all(a < c and c <= b + 1 for (a, b), (c, _) in zip(mine, mine[1:]))
    assert sorted((r["source_id"], r["line_start"], r["line_end"]) for r in rows if r["source_id"] > 1) == [(2, 1, 1), (3, 1, 1)]


def test_merge_small(spark):
    rows = [(1, 1, 2, "", 10), (1, 3, 4, "b", 500), (1, 5, 6, "c", 400), (1, 7, 8, "d", 20), (2, 1, 1, "x", 5)]
    at, placed = {}, []
    for source, a, b, title, chars in rows:  # characters before and up to the end, newlines too
        placed.append((source, a, b, title, at.get(source, 0), at.get(source, 0) + chars + 1))
        at[source] = placed[-1][-1]
    got = docs.merge_small(spark.createDataFrame(placed, "source_id long, line_start long, line_end long, title string, before long, until long"), 300).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 4, "b"), (1, 5, 8, "c"), (2, 1, 1, "x")]


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 10, 3.0), (1, 20, 2.0)], "q long, doc long, score double")
    b = spark.createDataFrame([(1, 20, 9.0), (1, 30, 1.0)], "q long, doc long, score double")
    ids = lambda df: [(r["doc"], r["score"]) for r in df.orderBy("rank").collect()]
    assert ids(retrieval.fuse(a, b)) == ids(retrieval.fuse(b, a))
    assert [d for d, _ in ids(retrieval.fuse(a, b))] == [20, 10, 30]


def test_retrieval_finds_the_unit(spark, tmp_path):
    sources = spark.createDataFrame([(1, "t", None, "alpha beta gamma\ndelta epsilon"), (2, "u", "d1", "zeta eta")], "source_id long, title string, domain_id string, text string")
    units = spark.createDataFrame([(10, 1, 1, 1, "completed", 100), (11, 1, 2, 2, "completed", 100), (20, 2, 1, 1, "completed", 200)], "unit_id long, source_id long, line_start long, line_end long, status string, outline_id long")
    points = spark.createDataFrame([(101, 10), (111, 11), (201, 20)], "point_id long, unit_id long")
    outlines = spark.createDataFrame([(100, None, 1, "alpha"), (200, None, 2, "other")], "outline_id long, parent_id long, source_id long, title string")
    relations = spark.createDataFrame([(101, 201, "related", "directed"), (111, 101, "contradicts", "directed")], "source_point long, target_point long, relation_type string, direction string")
    texts = {10: "alpha beta gamma", 11: "delta epsilon", 20: "zeta eta"}

    def made(name, rows):
        return index.open_or_create(spark, str(tmp_path / name), lambda: spark.createDataFrame(rows, "doc long, text string"))

    kb = retrieval.Store(
        sources, spark.createDataFrame([("d1",)], "domain_id string"), outlines, units, points, relations,
        made("u", list(texts.items())), made("p", [(101, texts[10]), (111, texts[11]), (201, texts[20])]), made("o", [(100, "alpha"), (200, "other")]),
    )
    questions = spark.createDataFrame([(7, "alpha beta", ""), (8, "nothing here", "")], "q long, text string, topic string")
    none = spark.createDataFrame([], "q long, domain_id string")
    got = {(r["q"], r["unit_id"]): (r["role"], r["path"], r["content"]) for r in retrieval.retrieve(questions, none, kb).collect()}
    assert got == {(7, 10): ("direct", "short", texts[10]), (7, 20): ("supporting", "short", texts[20]), (7, 11): ("conflict", "short", texts[11])}
    only = spark.createDataFrame([(7, "d1"), (7, "unknown")], "q long, domain_id string")
    assert retrieval.restrictions(only, kb.domains).collect() == [(7, "d1")]


def test_unknown_candidates_and_roles_are_errors(spark):
    cands = spark.createDataFrame([(1, 5, "what is alpha", "alpha"), (1, 6, "what is alpha", "beta"), (1, 7, "what is alpha", "gamma")], "q long, unit_id long, question string, content string")
    named = lambda *rows: spark.createDataFrame(rows, "q long, unit_id long, role string")
    got = {r["unit_id"]: r["role"] for r in retrieval.apply_roles(cands, named((1, 5, "direct"), (1, 6, "direct"), (1, 7, "irrelevant"))).collect()}
    assert got == {5: "direct", 6: "supporting"}
    for wrong in ((1, 9, "direct"), (1, 5, "best")):
        with pytest.raises(Exception, match="no candidate|no role"):
            retrieval.apply_roles(cands, named(wrong)).collect()


def test_index_generations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FAN", 0)  # no merging
    at = index.open_or_create(spark, str(tmp_path / "i"))
    rows = lambda *x: spark.createDataFrame(x, "doc long, text string")
    assert at.postings().collect() == [] and at.docs().collect() == [] and at.stats() == (0, 0)
    at.put(rows((1, "a b a"), (2, "b"), (3, None)))
    at.put(rows((2, "c"), (4, "d d")))
    at.remove(rows((1, ""), (9, "")))
    assert sorted((r["term"], r["doc"], r["tf"]) for r in at.postings().collect()) == [("c", 2, 1), ("d", 4, 2)]
    assert sorted((r["doc"], r["dl"]) for r in at.docs().collect()) == [(2, 1), (3, 0), (4, 2)]
    assert at.stats() == (3, 3) and sorted(map(tuple, at.frequencies().collect())) == [("c", 1), ("d", 1)]
    (tmp_path / "i" / "docs" / "seg=4-4").mkdir()  # a put that died before its documents were written
    assert at.generations() == [1, 2, 3] and at.docs().count() == 3
    at.compact()
    assert at.segments() == [(1, 3)] and at.segments(covered=True) == [(1, 1), (2, 2), (3, 3)]
    assert sorted((r["term"], r["doc"], r["tf"]) for r in at.postings().collect()) == [("c", 2, 1), ("d", 4, 2)] and at.stats() == (3, 3)
    assert index.probe(at) and at.docs().count() == 3
    assert not index.ensure_healthy(at, rows(*((i, "x") for i in range(9)))) and at.docs().count() == 9


def test_index_that_grows_answers_like_one_built_at_once(spark, tmp_path, monkeypatch):
    for name, value in (("SPLIT", 40), ("BLOCK", 8), ("BUCKET_ROWS", 200)):
        monkeypatch.setattr(index, name, value)
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    rnd = random.Random(11)
    word = lambda: f"w{int(rnd.paretovariate(0.6)) % 60}"
    state = {}
    grown = index.open_or_create(spark, str(tmp_path / "grown"))
    for step in range(10):
        new = {rnd.randrange(120): " ".join(["all", *(word() for _ in range(rnd.randrange(25)))]) for _ in range(30)}
        state |= new
        grown.put(spark.createDataFrame(list(new.items()), "doc long, text string"))
        if step == 6:
            gone = rnd.sample(sorted(state), 8)
            grown.remove(spark.createDataFrame([(d,) for d in gone], "doc long"))
            state = {d: t for d, t in state.items() if d not in gone}
    assert len(grown.segments()) <= 5
    once = index.open_or_create(spark, str(tmp_path / "once"), lambda: spark.createDataFrame(list(state.items()), "doc long, text string"))
    assert grown.stats() == once.stats() and sorted(map(tuple, grown.frequencies().collect())) == sorted(map(tuple, once.frequencies().collect()))
    questions = spark.createDataFrame([(q, " ".join(["all", *(word() for _ in range(6))])) for q in range(12)], "q long, text string")
    want = brute(state, [(r["q"], r["text"]) for r in questions.collect()], 5)
    ask = lambda at: sorted((r["q"], r["rank"], r["doc"], r["score"]) for r in retrieval.match(questions, at, 5, counts).collect())
    counts = {}
    assert ask(once) == want and counts["pairs"] < 12 * len(state)
    assert ask(grown) == want
    grown.compact()
    assert len(grown.segments()) == 1 and ask(grown) == want
    sizes = grown.blocks().groupBy("bucket").agg(F.sum("n").alias("n"), F.count_distinct("term", "salt").alias("parts")).collect()
    assert len(sizes) > 4 and all(r["n"] <= 400 or r["parts"] == 1 for r in sizes)
    assert grown.blocks().filter("term = 'all'").select("salt").distinct().count() == -(-len(state) // 40)


def brute(state, questions, limit):
    """The best documents by the score's definition."""
    words = {d: t.split() for d, t in state.items()}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    out = []
    for q, text in questions:
        scores = {}
        for t in set(text.split()):
            df = sum(t in w for w in words.values())
            for d, w in words.items():
                if t in w:
                    tf = w.count(t)
                    scores[d] = scores.get(d, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))
        best = sorted((-round(s, 6), d) for d, s in scores.items())[:limit]
        out += [(q, r, d, -s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out)


def test_closure_ends_on_cycles(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, 4), (9, None), (8, 9)], "id long, parent long")
    seeds = nodes.filter("id = 1")
    assert sorted(r["id"] for r in store.closure(nodes, "id", "parent", seeds).collect()) == [1, 2, 3, 4, 5]
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 12)], "id long, parent long")
    assert store.closure(chain, "id", "parent", chain.filter("id = 1")).count() == 11


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 5, "n")], "k string, n long, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z"), (None, 1, None)], "k string, n long, v string")
    assert sorted(map(tuple, store.upsert_add(old, new, ["k"], "n", ["v"]).collect()), key=str) == sorted([("a", 3, "y"), ("b", 1, "z"), (None, 6, "n")], key=str)
    assert store.insert_missing(old.filter("k = 'a'"), new.filter("k IS NOT NULL"), ["k"]).count() == 2


TRACES = "trace_id long, question_hash long, point_id long, question_terms string, quality string, created_at timestamp"


def traces(spark):
    from datetime import datetime, timedelta

    rnd = random.Random(3)
    rows = [(i, rnd.randrange(20), rnd.randrange(5), f"t{rnd.randrange(4)}", "confident", datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(200)]
    return spark.createDataFrame(rows, TRACES)


def test_cooccurrence_counts_once(spark):
    t = traces(spark)
    once = study.cooccurrence(t).select("question_terms", "point_id", "hit_count")
    twice = study.cooccurrence(t.unionByName(t)).select("question_terms", "point_id", "hit_count")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.agg(F.sum("hit_count")).first()[0] == t.select("question_hash", "point_id").distinct().count()


def test_stream_equals_batch(spark, tmp_path):
    t = traces(spark)
    t.orderBy("created_at").coalesce(1).write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/in")
    seen: dict[int, list] = {}

    def write(df, batch):
        seen[batch] = [tuple(r) for r in df.collect()]

    jobs.run_available(jobs.first_sights(jobs.read_stream(spark, f"{tmp_path}/in", t.schema)).select("question_hash", "point_id"), write, f"{tmp_path}/c", "append")
    got = [x for rows in seen.values() for x in rows]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in t.select("question_hash", "point_id").distinct().collect()}


def test_session_stream(spark, tmp_path):
    rows = [(1, 0, "a", False), (1, 1, "", False), (1, 2, "", True), (2, 0, "b", False), (1, 3, "c", False)]
    df = spark.createDataFrame(rows, "session_id long, turn_index long, subject string, interrupt boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    last: dict = {}

    def write(batch, _):
        last.update({r["session_id"]: (r["subject"], r["turns"]) for r in batch.collect()})

    jobs.run_available(jobs.session_state(jobs.read_stream(spark, f"{tmp_path}/in", df.schema)), write, f"{tmp_path}/c")
    assert last == {1: ("c", 4), 2: ("b", 1)}
    batch = session.subjects(df, F.col("interrupt"), F.col("subject")).filter("session_id = 1").orderBy("turn_index").collect()
    assert [r["current_subject"] for r in batch] == ["a", "a", None, "c"]
