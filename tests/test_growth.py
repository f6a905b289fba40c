"""What is shuffled and made: it may grow with the tables, not with questions times documents."""

import re

from pyspark.sql import functions as F

from lorespark.operators import docs, index, provider, refine, retrieval, store
from lorespark.plans import retrieving

DOCS = "source_id long, title string, domain_id string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_built_without_shuffling_texts(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(index, "stored", lambda df, name, f=index.stored: seen.setdefault(name, plan(df)) and f(df, name))
    at = index.open_or_create(spark, str(tmp_path / "i"), lambda: spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "c")], "doc long, text string"))
    assert "Exchange" not in seen["put"]
    assert sorted(map(tuple, at.postings().collect())) == [("a", 1, 1, 3), ("b", 1, 2, 3), ("c", 4, 1, 1)] and at.docs().count() == 4


def test_pairs_of_question_and_document_are_not_shuffled(spark, tmp_path, monkeypatch):
    at = index.open_or_create(spark, str(tmp_path / "i"), lambda: spark.range(3000).select(F.col("id").alias("doc"), F.concat_ws(" ", F.lit("x"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("text")))
    seen = {}
    monkeypatch.setattr(retrieval, "stored", lambda df, name, f=retrieval.stored: seen.setdefault(name, plan(df)) and f(df, name))
    questions = spark.range(40).select(F.col("id").alias("q"), F.concat(F.lit("x w"), F.col("id").cast("string")).alias("text"))
    got = retrieval.match(questions, at, 5).collect()
    assert sorted((r["q"], r["rank"], r["doc"]) for r in got) == [(q, k + 1, q + 50 * k) for q in range(40) for k in range(5)]
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", "\n".join(text for name, text in seen.items() if name not in ("seeds", "seed-scores")))
    assert keys and not any("doc#" in k and "q#" in k for k in keys)


def test_units_are_shuffled_once_and_without_their_text(spark, tmp_path):
    spark.createDataFrame([(1, "t", None, "a\nb")], DOCS).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    text = plan(retrieving._units(s).drop("content"))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_a_store_makes_what_is_asked_for(spark, tmp_path):
    spark.createDataFrame([(1, "t", None, "a\nb\nc\nd e"), (2, "u", "d1", "f")], DOCS).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    kb = retrieving._store(s, spark.createDataFrame([("d1",)], "domain_id string"))
    assert kb.outlines.count() >= 2 and kb.points.count() == kb.points.distinct().count()
    made = __import__("os").listdir(retrieving._at(s, "x").rsplit("/", 1)[0])
    assert sorted(made) == ["table-outlines", "table-points"] and "content" not in kb.units.columns


def test_postings_are_shuffled_neither_by_an_index_nor_by_a_search(spark, tmp_path, monkeypatch):
    """Findings F3 to F8 and F19 to F21 of round 3: disk and time of recalls."""
    words = F.concat_ws(" ", F.lit("x 中文字"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")), F.concat(F.lit("W"), (F.col("id") % 7).cast("string")))
    at = index.open_or_create(spark, str(tmp_path / "i"), lambda: spark.range(300).select(F.col("id").alias("doc"), words.alias("text")))
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["docs", "terms"]
    seen = {}
    monkeypatch.setattr(retrieval, "stored", lambda df, name, f=retrieval.stored: seen.setdefault(name, plan(df)) and f(df, name))
    questions = spark.range(9).select(F.col("id").alias("q"), F.concat(F.lit("文字 w"), F.col("id").cast("string")).alias("text"))
    ask = lambda: sorted(map(tuple, retrieval.match(questions, at, 5).collect()))
    one = ask()
    assert [r[1] for r in one if r[0] == 3] == [3, 10, 17, 24, 31] and [r[1] for r in one if r[0] == 8] == [0, 1, 2, 3, 4]
    assert "MapInArrow" in seen["match"] and set(re.findall(r"hashpartitioning\((\w+)#", seen["match"])) == {"q"}
    monkeypatch.setattr(retrieval, "MAX_TERMS", 5)  # several passes
    monkeypatch.setattr(retrieval, "SUMS", 20)
    assert ask() == one


def test_a_cascade_finds_what_goes_once(spark, tmp_path, monkeypatch):
    """Finding F31 of round 3: points were shuffled for each table that loses rows."""
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    tables = {"units": frame([(1, 3), (2, 4)], "unit_id source_id"), "points": frame([(10, 1), (20, 2), (None, 1)], "point_id unit_id"), "relations": frame([(10, 20), (20, 20), (20, 10)], "source_point target_point")}
    seen = []
    monkeypatch.setattr(store, "stored", lambda df, name, f=store.stored: seen.append(name) or f(df, name))
    after = store.delete_cascade(tables, frame([(3,)], "source_id"))
    assert {n: sorted(map(tuple, df.collect())) for n, df in after.items()} == {"units": [(4, 2)], "points": [(2, 20)], "relations": [(20, 20)]}
    assert seen == ["gone-units", "gone"] and "unit_id" in plan(after["points"]).split("LeftAnti")[0]


def test_replies_are_held_for_some_rows_at_a_time(spark, monkeypatch):
    """Findings F32 and F34 of round 3: a batch's requests and replies were held together."""
    monkeypatch.setattr(provider, "ROWS", 3)
    rows = spark.range(10, numPartitions=1).select(F.col("id").alias("source_id"), F.lit(1).alias("line_start"), F.when(F.col("id") != 4, F.concat(F.lit("a\n\nb"), F.col("id").cast("string"))).alias("text"))
    got = provider.extract_units(rows, provider.line_units)
    assert "MapInArrow" in plan(got) and "ArrowEvalPython" not in plan(got)
    found = {r["source_id"]: (r["status"], [u["center"] for u in r["units"]], len(r["points"])) for r in got.collect()}
    assert found == {i: ("completed", ["a", f"b{i}"], 2) if i != 4 else ("extraction_failed", [], 0) for i in range(10)}


def test_lines_are_shuffled_once_for_texts_of_parts_and_not_for_sizes(spark):
    """Findings F23, F28, F29 and F33 of round 3."""
    rows = spark.createDataFrame([(1, i, f"l{i}") for i in range(1, 6)], "source_id long, line_no long, line string")
    parts = spark.createDataFrame([(1, 2, 3, "x"), (1, 5, 9, "y"), (1, 7, 8, "z"), (2, 1, 1, "w")], "source_id long, line_start long, line_end long, title string")
    got = refine.bodies(parts, rows)
    assert sorted((r["title"], r["text"]) for r in got.collect()) == [("x", "l2\nl3"), ("y", "l5")]
    assert set(re.findall(r"hashpartitioning\(([^)]*)\)", plan(got))) <= {k for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan(got)) if k.startswith("source_id#")}
    shuffled = re.search(r"Exchange hashpartitioning.*?\n(.*)", plan(docs.line_chars(rows)))[1]
    assert "line#" not in shuffled.split("AS n")[0].split("[")[-1].replace("char_length(line#", "") and "char_length" in shuffled


def test_an_index_and_the_tables_of_a_store_are_packed(spark, tmp_path):
    """Findings F4 to F7 of round 3: disk of recalls."""
    import pyarrow.parquet as pq

    at = index.open_or_create(spark, str(tmp_path / "i"), lambda: spark.createDataFrame([(1, "b a b")], "doc long, text string"))
    at.put(spark.createDataFrame([(2, "c")], "doc long, text string"))
    spark.createDataFrame([(1, "t", None, "a\nb")], DOCS).write.parquet(str(tmp_path / "s"))
    points = retrieving._store(spark.read.parquet(str(tmp_path / "s")), None).points
    files = [*(tmp_path / "i").rglob("*.parquet"), *(n.removeprefix("file://") for n in points.inputFiles())]
    assert len(files) > 3 and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
