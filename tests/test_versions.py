import pytest
from pyspark.sql import functions as F

from lorespark.operators import index, retrieval, session
from lorespark.sources import versions
from lorespark.streaming import jobs


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"word{i} all") for i in ids], "doc long, text string")


def test_changes_of_tables_and_an_index_appear_together(spark, tmp_path):
    root = str(tmp_path / "store")
    one = versions.open_version(spark, root).commit({"a": rows(spark, 1, 2), "b": rows(spark, 1)}, {"words": lambda at: at.put(rows(spark, 1, 2))})
    found = lambda v: sorted(r["doc"] for r in retrieval.match(spark.createDataFrame([(1, "all")], "q long, text string"), v.index("words"), 9).collect())
    assert found(one) == [1, 2]

    def breaks(at):
        at.remove(rows(spark, 2))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        one.commit({"a": rows(spark, 1)}, {"words": breaks})
    now = versions.open_version(spark, root)
    assert now.number == 1 and now.table("a").count() == 2 and found(now) == [1, 2]
    two = now.commit({"a": rows(spark, 2, 3)}, {"words": lambda at: (at.remove(rows(spark, 1)), at.put(rows(spark, 3)))})
    assert found(two) == [2, 3] and found(now) == [1, 2] and now.table("a").count() == 2
    assert versions.open_version(spark, root).tables["b"] == one.tables["b"]
    with pytest.raises(versions.Conflict):
        now.commit({"b": rows(spark, 9)})
    assert versions.open_version(spark, root).number == 2
    versions.vacuum(spark, root)
    assert versions.versions(spark, root) == [2] and found(versions.open_version(spark, root)) == [2, 3]
    assert len(list((tmp_path / "store" / "tables" / "a").iterdir())) == 1 and len(list((tmp_path / "store" / "tables" / "b").iterdir())) == 1


def test_migrations_run_in_order_and_once(spark, tmp_path):
    ran = []

    def step(name):
        def run(v):
            ran.append(name)
            return {"a": v.table("a").withColumn(name, F.lit(len(ran)))}

        return name, run

    v = versions.open_version(spark, str(tmp_path)).commit({"a": rows(spark, 1)}).migrate([step("m1")])
    v = versions.open_version(spark, str(tmp_path)).migrate([step("m1"), step("m2"), step("m3")])
    assert ran == ["m1", "m2", "m3"] and v.migrations == ("m1", "m2", "m3") and v.table("a").first()["m3"] == 3

    def fails(_):
        raise ValueError

    with pytest.raises(ValueError):
        v.migrate([step("m1"), step("m4"), ("m5", fails), step("m6")])
    assert versions.open_version(spark, str(tmp_path)).migrations == ("m1", "m2", "m3", "m4") and "m6" not in ran


def test_a_version_keeps_its_index_through_merges(spark, tmp_path):
    v = versions.open_version(spark, str(tmp_path)).commit({}, {"i": lambda at: at.put(rows(spark, 0))})
    seen = [v]
    for i in (1, 2):
        v = v.commit({}, {"i": lambda at, i=i: at.put(rows(spark, i))})
        seen.append(v)
    assert len(index.Index(spark, f"{tmp_path}/indexes/i").segments()) < 3
    for n, old in enumerate(seen):
        assert old.index("i").stats()[0] == n + 1 == old.index("i").docs().count()


EVENTS = "session_id long, turn_index long, kind string, text string, intent string, subject string, at timestamp"


def test_state_of_idle_sessions_goes(spark, tmp_path):
    def batch(*given):
        made = [(s, t, "turn", "why", "ask", f"s{t}" if t == 1 else "", at) for s, t, at in given]
        spark.createDataFrame(made, EVENTS.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.session_machine(jobs.read_stream(spark, f"{tmp_path}/in", EVENTS), idle_ms=60_000, late="1 second")
        q = jobs.run_available(stream, jobs.table_writer(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", "append")
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert batch((1, 1, 100), (2, 1, 100)) >= 2
    before = batch((2, 2, 150))
    after = batch((3, 1, 10_000))  # both others have been idle by the watermark
    assert after < before
    batch((1, 2, 10_010), (2, 3, 10_010))
    out = {(r["session_id"], r["turn_index"]): r["current_subject"] for r in jobs.read_batches(spark, f"{tmp_path}/out", session.OUT).collect()}
    assert out[2, 2] == "s1" and out[1, 2] == out[2, 3] == ""


def test_a_stream_from_snapshots_equals_a_replay(spark, tmp_path):
    given = [(s, t, "turn", "继续" if t == 4 else "why", "ask", f"s{t}" if (s + t) % 3 == 0 else "") for s in range(6) for t in range(1, 6)]
    events = spark.createDataFrame(given, EVENTS.rsplit(", ", 1)[0])
    states = session.snapshots(events.filter("turn_index < 3 AND session_id <> 5"))
    events.filter("turn_index >= 3 OR session_id = 5").repartition(2).write.parquet(f"{tmp_path}/in")
    stream = jobs.session_machine(jobs.read_stream(spark, f"{tmp_path}/in", events.schema, 9), states)
    jobs.run_available(stream, jobs.table_writer(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", "append")
    got = sorted(map(str, jobs.read_batches(spark, f"{tmp_path}/out", session.OUT).collect()))
    want = sorted(map(str, session.replay(events).filter("turn_index >= 3 OR session_id = 5").collect()))
    assert got == want


def test_progress_by_stage_and_source(spark, tmp_path):
    spark.range(90).selectExpr("id", "id % 3 AS source").repartition(3).write.parquet(f"{tmp_path}/in")
    heard = jobs.Progress()
    spark.streams.addListener(heard)
    keys = tuple(f"s{k}=source = {k}" for k in range(3))
    read = jobs.observed(jobs.read_stream(spark, f"{tmp_path}/in", "id long, source long"), "read", keys)
    jobs.run_available(jobs.observed(read.filter("id < 30"), "kept", keys), jobs.table_writer(f"{tmp_path}/out"), f"{tmp_path}/c", "append")
    import time

    for _ in range(100):
        if heard.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(heard)
    assert heard.stages() == {("read", "rows"): 90, ("kept", "rows"): 30, **{("read", f"s{k}"): 30 for k in range(3)}, **{("kept", f"s{k}"): 10 for k in range(3)}}
