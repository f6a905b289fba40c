import json
import random

from pyspark.sql import functions as F

from lorespark.operators import answer, docs, provider, refine, sketch, store, study, tree


def test_tree_against_recursion(spark):
    rnd = random.Random(3)
    rows = [(d, i + 1, rnd.randrange(1, 5), f't"{i}') for d in range(20) for i in range(rnd.randrange(1, 25))]
    heads = spark.createDataFrame(rows, "source_id long, line_no long, level long, title string")
    totals = heads.groupBy("source_id").agg(F.max("line_no").alias("total_lines"))
    got = {r["source_id"]: json.loads(r["tree"]) for r in tree.nested(docs.outline(heads, totals)).collect()}

    def nest(items):
        out, stack = [], []
        for _, line, level, title in items:
            node = {"title": title, "line": line, "children": []}
            while stack and stack[-1][0] >= level:
                stack.pop()
            (stack[-1][1]["children"] if stack else out).append(node)
            stack.append((level, node))
        return out

    assert got == {d: nest([r for r in rows if r[0] == d]) for d in range(20)}


def test_replies_are_asked_for_again():
    calls = []

    def flaky(request):
        calls.append(request)
        if len(calls) < 2:
            raise OSError
        return '{"a": 1}'

    assert provider.reply(flaky, "x", 2) == '{"a": 1}' and len(calls) == 2
    assert provider.reply(lambda r: "no json", "x", 2) is None
    assert provider.reply(lambda r: "[1]", "x", 2) is None
    assert provider.reply(flaky, None, 2) is None


def test_failures_have_defined_results(spark):
    bad = lambda r: "no"
    segs = spark.createDataFrame([(1, 1, "a\nb"), (2, 1, None)], "source_id long, line_start long, text string")
    assert [(r["status"], r["units"], r["points"]) for r in provider.extract_units(segs, bad).collect()] == [("extraction_failed", [], [])] * 2
    q = spark.createDataFrame([(1, "why", [("e1", "x")]), (2, "who", None)], "q long, question string, evidence array<struct<id: string, content: string>>")
    assert [(r["content"], r["citations"]) for r in provider.generate(q, bad).orderBy("q").collect()] == [(provider.FAILED, []), (provider.NO_EVIDENCE, [])]
    nodes = spark.createDataFrame([(1, 1, "one"), (1, 2, "two")], "source_id long, line_start long, title string")
    assert sorted(r["summary"] for r in provider.node_summaries(nodes, bad).collect()) == ["one", "two"]
    points = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "unit_id long, point_id long, content string")
    units = spark.createDataFrame([(1, 1, None, "c")], "unit_id long, source_id long, outline_id long, center string")
    none = spark.createDataFrame([], "outline_id long, parent_id long")
    assert provider.relations(points, units, none, bad).collect() == []
    wrong = lambda r: json.dumps({"relations": [{"from": 1, "to": 1, "type": "related"}, {"from": 1, "to": 9, "type": "related"}, {"from": 1, "to": 2, "type": "odd"}]})
    assert provider.relations(points, units, none, wrong).collect() == []


def test_relations_cross_units_within_a_chapter_only(spark):
    outlines = spark.createDataFrame([(1, None), (2, 1), (3, 2), (10, None), (11, 10)], "outline_id long, parent_id long")
    units = spark.createDataFrame([(1, 7, 1, "a"), (2, 7, 3, "b"), (3, 7, 11, "c"), (4, 7, None, "d"), (5, 7, 99, "e"), (6, 8, 11, "f"), (7, 8, 3, "g")], "unit_id long, source_id long, outline_id long, center string")
    points = spark.createDataFrame([(p, p % 5 + 1, "x") for p in range(40)] + [(100, 6, "x"), (101, 7, "x")], "point_id long, unit_id long, content string")

    def all_pairs(request):
        ids = [p["point_id"] for p in json.loads(request)["points"]]
        return json.dumps({"relations": [{"from": a, "to": b, "type": "related"} for a in ids for b in ids if a < b]})

    chapter = {1: 1, 2: 1, 3: 10, 4: None, 5: None}
    pairs = {(r["source_point"], r["target_point"]) for r in provider.relations(points, units, outlines, all_pairs, 20).collect()}
    assert pairs == {(a, b) for a in range(40) for b in range(a + 1, 40) if chapter[a % 5 + 1] == chapter[b % 5 + 1]} | {(100, 101)}
    together = provider.relations(points, units, outlines, all_pairs, 40).filter("source_point < 40")
    assert together.count() == 40 * 39 // 2
    sizes = [len(r["points"]) for r in provider.related_batches(points, units, outlines, 5).collect()]
    assert max(sizes) == 5


def test_roots_of_deep_trees_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (1002, 1001), (2000, 9999), (3000, 3000)]
    got = {r["id"]: r["root"] for r in tree.root_of(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    assert got == {**{i: 0 for i in range(300)}, 1000: None, 1001: None, 1002: None, 2000: 2000, 3000: None}
    assert tree.root_of(spark.createDataFrame([], "id long, parent long"), "id", "parent").collect() == []


def test_sections_and_long_leaves_cover_the_text(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(300))
    d = spark.createDataFrame([(1, text), (2, "short\ntext")], "source_id long, text string")
    rows = sketch.sections(d, provider.first_lines, 1000).collect()
    mine = sorted((r["line_start"], r["line_end"]) for r in rows if r["source_id"] == 1)
    assert mine[0][0] == 1 and mine[-1][1] == 300 and all(b[0] == a[1] + 1 for a, b in zip(mine, mine[1:]))
    assert [(r["title"], r["line_start"], r["line_end"]) for r in rows if r["source_id"] == 2] == [("short", 1, 2)]
    leaves = spark.createDataFrame([(1, 11, 310, 2, "long", text)], "source_id long, line_start long, line_end long, level long, title string, text string")
    got = sorted(refine.by_windows(leaves, 1000).collect(), key=lambda r: r["line_start"])
    assert got[0]["line_start"] == 11 and got[-1]["line_end"] == 310 and any(b["line_start"] <= a["line_end"] for a, b in zip(got, got[1:]))
    assert [r["title"] for r in got] == [f"long（{i}/{len(got)}）" for i in range(1, len(got) + 1)]
    tiles = sorted((r["line_start"], r["line_end"]) for r in refine.by_windows(leaves, 1000, tile=True).collect())
    assert tiles[0][0] == 11 and tiles[-1][1] == 310 and all(b[0] == a[1] + 1 for a, b in zip(tiles, tiles[1:]))


def test_route_and_updates(spark):
    rows = spark.createDataFrame([(0, 0, False, False), (2, 1, False, False), (2, 0, False, False), (2, 1, True, False), (None, None, True, True)], "n int, d int, c boolean, f boolean")
    got = rows.select(answer.route(F.col("n"), F.col("d"), F.col("c"), F.col("f")).alias("r")).collect()
    assert [r["r"] for r in got] == ["none", "short", "deep", "deep", "none"]
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id int, a string, b string")
    new = spark.createDataFrame([(1, None), (2, "c")], "id int, a string")
    assert sorted(map(tuple, store.update_columns(old, new, "id").collect())) == [(1, "a", "x"), (2, "c", "y")]


def test_merged_cooccurrence_equals_one_pass(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(5), rnd.randrange(4), f"t{rnd.randrange(2)}", rnd.choice(["confident", "gap"])) for i in range(200)]
    t = spark.createDataFrame(rows, "trace_id long, question_hash long, point_id long, question_terms string, quality string").withColumn("created_at", F.timestamp_seconds("trace_id"))
    merged = study.cooccurrence_merge(t.filter("trace_id < 10"), t.filter("trace_id >= 10"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, study.cooccurrence(t).select(merged.columns).collect()))
