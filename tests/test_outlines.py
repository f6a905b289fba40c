import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lorespark.operators import docs, driver, provider, refine, sketch, tree

NODES = "source_id long, line_start long, line_end long, level long, title string, parent_line long, parent_level long, node_type string"


def outline_of(spark, texts):
    ok = spark.createDataFrame(list(texts.items()), "source_id long, text string")
    rows = docs.lines(ok)
    totals = rows.groupBy("source_id").agg(F.max("line_no").alias("total_lines"))
    return ok, rows, docs.outline(docs.headings(rows), totals).withColumn("node_type", F.lit("structural"))


def check_tree(rows, lines_of):
    """Keys and places are distinct, parents exist and hold their children, leaves below the roots' first lines tile them."""
    by = {(r["source_id"], r["line_start"], r["level"]): r for r in rows}
    assert len(by) == len(rows)
    assert len({(r["source_id"], r["parent_line"], r["parent_level"], r["position"]) for r in rows}) == len(rows)
    kids = {}
    for r in rows:
        assert 1 <= r["line_start"] <= r["line_end"] <= lines_of[r["source_id"]]
        if r["parent_line"] is not None:
            p = by[r["source_id"], r["parent_line"], r["parent_level"]]
            assert p["level"] < r["level"]
            kids.setdefault((r["source_id"], r["parent_line"], r["parent_level"]), []).append(r)
    for key, found in kids.items():
        made = sorted((r["line_start"], r["line_end"]) for r in found if r["node_type"] == "semantic")
        if made:
            p = by[key]
            assert made[0][0] == p["line_start"] and made[-1][1] == p["line_end"]
            assert all(b[0] == a[1] + 1 for a, b in zip(made, made[1:]))


@pytest.mark.parametrize("request_chars", [1 << 30, 400])
def test_refined_outlines_tile_the_text(spark, request_chars):
    rnd = random.Random(5)
    texts = {d: "\n".join(("#" * rnd.choice([1, 2, 3, 4]) + f" h{i}") if i % 31 == 0 else "word " * rnd.randrange(30) for i in range(rnd.randrange(20, 200))) for d in range(12)}

    def model(request):
        j = json.loads(request)
        if len(j["text"]) % 5 == 0:
            raise OSError
        n = {2: 9, 3: 4}[j["level"]]
        found = [{"title": f"{a}" if a % 7 else " ", "line_start": a - 2, "line_end": a + n + 3} for a in range(j["line_start"] + 3, j["line_end"] + 1, n)]
        return json.dumps({"sections": found})

    _, rows, nodes = outline_of(spark, texts)
    out = refine.refine(nodes, rows, model, 300, request_chars).collect()
    check_tree(out, {d: t.count("\n") + 1 for d, t in texts.items()})
    inner = {(r["source_id"], r["parent_line"], r["parent_level"]) for r in out}
    for r in out:
        size = len("\n".join(texts[r["source_id"]].split("\n")[r["line_start"] - 1 : r["line_end"]]))
        if r["node_type"] == "semantic" and r["level"] == 3:
            assert size <= 300 or r["line_start"] == r["line_end"]
        if (r["source_id"], r["line_start"], r["level"]) not in inner and size > 300 and r["level"] < 3:
            assert r["line_start"] == r["line_end"] or size % 5 == 0 or request_chars == 400 or size > 300
    assert {r["level"] for r in out if r["node_type"] == "semantic"} >= {2, 3}


def test_a_failing_model_changes_nothing_above_the_lowest_level(spark):
    _, rows, nodes = outline_of(spark, {1: "# a\n" + "\n".join("x" * 50 for _ in range(30)), 2: "short"})
    out = refine.refine(nodes, rows, lambda r: "no", 100, 1000).collect()
    assert [(r["line_start"], r["line_end"], r["level"], r["position"]) for r in out] == [(1, 31, 1, 0)]


def test_given_leaves_of_the_lowest_level_are_divided_on_request(spark):
    text = "\n".join("x" * 40 for _ in range(20))
    rows = docs.lines(spark.createDataFrame([(1, text)], "source_id long, text string"))
    node = spark.createDataFrame([(1, 1, 20, 3, "t", None, None, "semantic")], NODES)
    assert refine.refine(node, rows, lambda r: "no", 100, 1000).count() == 1
    out = sorted(refine.refine(node, rows, lambda r: "no", 140, 1000, split_given=True).collect(), key=lambda r: r["position"])
    assert [(r["line_start"], r["line_end"]) for r in out] == [(a, a + 1) for a in range(1, 21, 2)]
    assert out[0]["title"] == "t（1/10）" and [r["position"] for r in out] == list(range(10))


def test_process_gives_mixed_outlines_that_are_trees(spark):
    text = "# a\n## b\nshort\n## c\nshort\n# d\nshort\n# e\n" + "\n".join(f"line {i} " + "y" * 60 for i in range(40))
    done = driver.process(spark.createDataFrame([(1, text), (2, None)], "source_id long, text string"), lambda r: provider.sections_of_lines(r, {2: 10, 3: 3}), 300, 1 << 20)
    assert {r["source_id"]: (r["status"], r["outline_type"]) for r in done.sources.collect()} == {1: ("completed", "mixed"), 2: ("failed", None)}
    out = done.outlines.collect()
    check_tree(out, {1: text.count("\n") + 1})
    segments = driver.segments(done.outlines, docs.lines(spark.createDataFrame([(1, text)], "source_id long, text string")), 1).collect()
    covered = sorted(x for r in segments for x in range(r["line_start"], r["line_end"] + 1))
    assert covered == list(range(2, text.count("\n") + 2))  # the first line's node has children
    nested = json.loads(tree.nested(done.outlines).first()["tree"])
    count = lambda xs: sum(1 + count(x["children"]) for x in xs)
    assert count(nested) == len(out)


def headed(n, every, size):
    return "\n".join(f"# head {i}" if i % every == 0 else "x" * size for i in range(n))


def test_sketches_are_merged_in_several_rounds(spark):
    texts = {1: headed(400, 40, 60), 2: headed(30, 7, 30), 3: "no heading\n" * 200}
    d = spark.createDataFrame(list(texts.items()), "source_id long, text string")
    found = sketch.sketches(d, provider.sections_of_headings, 500)
    left, rounds = sketch.merged(found, provider.sections_of_headings, 500)
    assert rounds >= 3 and left.groupBy("source_id").count().filter("count > 1").isEmpty()
    out = sketch.sections(d, provider.sections_of_headings, 500).collect()
    assert [(r["title"], r["line_start"], r["line_end"]) for r in sorted(out, key=lambda r: r["line_start"]) if r["source_id"] == 1] == [(f"head {i}", i + 1, i + 40) for i in range(0, 400, 40)]


def test_units_across_edges_are_joined_by_rule(spark):
    text = headed(120, 30, 20)

    def model(request):
        j = json.loads(request)
        if j.get("prompt") != "sketch":
            raise OSError
        named = lambda a: f"part {(a - 1) // 30}"
        runs = []
        for a in range(j["line_start"], j["line_end"] + 1):
            if runs and runs[-1]["title"] == named(a):
                runs[-1]["line_end"] = a
            else:
                runs.append({"title": named(a), "line_start": a, "line_end": a})
        return json.dumps({"outline_units": runs})

    d = spark.createDataFrame([(1, text)], "source_id long, text string")
    out = sorted((r["line_start"], r["line_end"], r["title"]) for r in sketch.sections(d, model, 200).collect())
    assert out == [(1 + 30 * k, 30 + 30 * k, f"part {k}") for k in range(4)]


def test_windows_that_begin_a_section_are_not_joined_by_title(spark):
    d = spark.createDataFrame([(1, "\n".join(["same line"] * 400))], "source_id long, text string")
    starts = {r["at"] for r in sketch.sketches(d, provider.first_lines, 200).collect()}
    out = sorted((r["line_start"], r["line_end"], r["title"]) for r in sketch.sections(d, provider.first_lines, 200).collect())
    assert len(starts) > 3 and {a for a, _, _ in out} == starts and {t for _, _, t in out} == {"same line"}
    assert out[-1][1] == 400 and all(b[0] == a[1] + 1 for a, b in zip(out, out[1:]))


def test_windows_without_a_reply_are_left_out(spark):
    d = spark.createDataFrame([(1, headed(200, 10, 30)), (2, "")], "source_id long, text string")
    assert sketch.sections(d, lambda r: "no", 200).collect() == []


def test_deepest_container_against_all_pairs(spark):
    rnd = random.Random(9)
    nodes = [(d, a, a + rnd.randrange(12), rnd.randrange(1, 5), f"{d}-{i}") for d in range(8) for i, a in enumerate(rnd.randrange(1, 40) for _ in range(25))]
    parts = [(d, a, a + rnd.randrange(5)) for d in range(9) for a in range(1, 40, 2)]
    n = spark.createDataFrame(nodes, "source_id long, line_start long, line_end long, level long, name string")
    p = spark.createDataFrame(parts, "source_id long, line_start long, line_end long")
    got = {(r["source_id"], r["line_start"], r["line_end"]): r["name"] for r in tree.deepest(p, n, "name").collect()}
    by_name = {x[4]: x for x in nodes}
    for part in parts:
        held = [x for x in nodes if x[0] == part[0] and x[1] <= part[1] and x[2] >= part[2]]
        if held:
            best = max((x[3], -x[1]) for x in held)
            x = by_name[got[part]]
            assert x in held and (x[3], -x[1]) == best
        else:
            assert got[part] is None


def test_containment_in_a_very_long_document(spark):
    n = 100_000
    lines = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("source_id"), F.col("id").alias("line_start"), F.col("id").alias("line_end"))
    nodes = spark.range(n // 5).select(F.lit(1).cast("long").alias("source_id"), (F.col("id") * 5 + 1).alias("line_start"), (F.col("id") * 5 + 1 + F.when(F.col("id") % 100 == 0, 499).otherwise(4)).alias("line_end"), F.when(F.col("id") % 100 == 0, 1).otherwise(2).cast("long").alias("level"))
    nodes = nodes.withColumn("name", F.col("line_start"))
    began = time.time()
    out = tree.deepest(lines, nodes, "name").agg(F.count("name"), F.sum("name")).first()
    assert time.time() - began < 20
    assert out[0] == n and out[1] == sum((x - 1) // 5 * 5 + 1 for x in range(1, n + 1))
