"""Steps beside the tables: replies and their schemas, settings, conversion, streamed answers, the session machine, streams that run again."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lorespark.operators import answer, provider, schema, session, trace
from lorespark.sources import config, convert
from lorespark.streaming import jobs


def test_mended_json():
    for raw, want in (
        ('x ```json\n{"a": [1, 2,]}\n```', {"a": [1, 2]}), ('{"a": "one\ntwo"}', {"a": "one\ntwo"}), ('{"a": {"b": [1, {"c": "d"}]', {"a": {"b": [1, {"c": "d"}]}}), ("[1,2]", [1, 2]),
    ):
        assert json.loads(schema.mended(schema.found(raw))) == want
    assert schema.mended("no json") == "no json"


def test_schema_errors():
    rule = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "minItems": 2, "items": {"type": "integer", "minimum": 0}}, "b": {"enum": ["x", "y"]}, "c": {"type": ["string", "null"], "minLength": 2}}}
    assert schema.errors({"a": [1, 2.0], "b": "x", "c": None}, rule) == []
    assert schema.errors([], rule) == ["$: not object"]
    assert schema.errors({}, rule) == ["$: lacks a"]
    assert schema.errors({"a": [True], "b": "z", "c": "d"}, rule) == ["$.a: fewer than 2 items", "$.a[0]: not integer", "$.b: not one of ['x', 'y']", "$.c: shorter than 2"]
    assert schema.errors({"a": [-1, 2]}, rule) == ["$.a[0]: under 0"]


def test_model_client():
    rule = {"type": "object", "required": ["a"]}
    waited, calls = [], []

    def transport(request):
        calls.append(request)
        if len(calls) < 3:
            raise OSError
        return '{"a": 1}' if "repair" in request else "{}"

    assert schema.ModelClient(transport, 3, waited.append).complete_json("x", rule) == '{"a": 1}'
    assert waited == [1.0, 2.0] and calls[:3] == ["x"] * 3 and json.loads(calls[3])["errors"] == ["$: lacks a"]
    with pytest.raises(OSError):
        schema.ModelClient(lambda r: (_ for _ in ()).throw(OSError()), 1, lambda _: None).complete("x")
    with pytest.raises(ValueError):
        schema.ModelClient(lambda r: "{}", 0).complete_json("x", rule)


def test_settings(tmp_path):
    env = {"HOST": "h", "LORESPARK_A_PORT": "7", "LORESPARK_A_ON": "maybe"}
    got = config.parse("# top\na:\n  host: ${HOST}-${NONE}x # note\n  port: 1\n  on: true\n  deep:\n    list: [1, two]\nb: 'x: y'\nc: 2.5\n", env)
    assert got == {"a.host": "h-x", "a.port": 7, "a.on": True, "a.deep.list": [1, "two"], "b": "x: y", "c": 2.5}
    at = tmp_path / "c.yml"
    at.write_text("b: 1")
    assert config.load(env={"LORESPARK_CONFIG": str(at)}) == {"b": 1} == config.load(str(at), {})
    with pytest.raises(FileNotFoundError):
        config.find(str(tmp_path / "none.yml"))


class Service:
    def __init__(self, polls, status="processing"):
        self.polls, self.status = polls, status

    def submit(self, name, content):
        return name, self.status

    def poll(self, task):
        self.polls -= 1
        return ("processing", "") if self.polls > 0 else ("finished", task)

    def download(self, at):
        return f"text of {at}".encode()


def test_conversion_waits_until_the_deadline():
    waits = []
    assert convert.converted(Service(3), "f", b"", 2.0, 10.0, waits.append) == "text of f" and waits == [2.0, 2.0]
    with pytest.raises(TimeoutError):
        convert.converted(Service(99), "f", b"", 2.0, 10.0, waits.append)
    with pytest.raises(RuntimeError, match="unexpected status"):
        convert.converted(Service(1, "full"), "f", b"", 2.0, 10.0)


def test_streamed_answers():
    def words(request):
        yield from json.loads(request)["question"].split(" ")
        if "fail" in request:
            raise OSError

    evidence = [{"id": "e", "content": "x"}]
    assert list(answer.stream("a b\nc", evidence, words)) == [("started", ""), ("chunk", "a"), ("chunk", "b\nc"), ("done", "ab\nc")]
    assert list(answer.stream("x", [], words)) == [("started", ""), ("done", provider.NO_EVIDENCE)]
    assert list(answer.stream("fail", evidence, words))[-1] == ("failed", provider.FAILED)
    assert list(answer.delivered(iter([("chunk", "a\nb")]))) == ["event: chunk\ndata: a\\nb\n\n"]


def test_batches_are_asked_again_for_what_failed(spark):
    seen = []

    def shaky(requests):
        seen.append(len(requests))
        return [json.dumps({"n": int(r)}) if int(r) % 2 or len(requests) == 1 else None for r in requests]

    df = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "r string").coalesce(1)
    got = [r["n"] for r in df.select(provider.ask_together(F.col("r"), shaky, "n int")["n"].alias("n")).collect()]
    assert got == [1, 2, 3, None]


def test_session_machine():
    S, E = session.State, session.Event

    def run(*events):
        state, out = S(), []
        for e in events:
            state, action, query = session.advance(state, e)
            out.append((action, query))
        return state, out

    state, out = run(E("turn", "hi", "greet"), E("clarify", "tax"), E("turn", "and the rate?", "rate"), E("working", "next rate"), E("turn", "继续"), E("turn", "停下"), E("turn", "x", "y"), E("clarify", ""), E("turn", "x", "yes"))
    assert out == [("clarify", ""), ("retrieve", "tax greet"), ("retrieve", "and the rate?"), ("noted", ""), ("retrieve", "next rate"), ("interrupted", ""), ("clarify", ""), ("skip", ""), ("retrieve", "yes")]
    assert state == S(intent="yes", last_reply="refused")
    state, _ = run(*(E("turn", "q", "i", f"s{i}") for i in range(5)))
    assert state.recent == "s2\ns3\ns4" and state.current == "s4"


def test_gap_batches_that_come_again_count_once(spark, tmp_path):
    known = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "trace_id long, question_terms string")
    events = lambda *ids: spark.createDataFrame([(i, i, json.dumps({"question": f"q{i}"})) for i in ids], "event_id long, trace_id long, payload string")
    write = jobs.gap_writer(str(tmp_path), known, 2)
    for batch, number in ((events(1, 4), 0), (events(2, 3), 1), (events(2, 3), 1)):
        write(batch, number)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/gaps/after=1").select("question_terms", "hit_count", "question", "crossed").collect())
    assert got == [("a", 2, "q2", True), ("b", 1, "q3", False)]
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/processed").collect()) == [1, 2, 3, 4]


def test_scheduled_job_runs_until_it_is_stopped(spark, tmp_path):
    runs = []
    query = jobs.every(spark, runs.append, "200 milliseconds", str(tmp_path / "c"), first_after=0.5)
    begun = time.monotonic()
    while len(runs) < 2 and time.monotonic() - begun < 30:
        time.sleep(0.1)
    query.stop()
    assert len(runs) >= 2 and runs == sorted(set(runs))


def test_traces_without_evidence_are_gaps(spark):
    schema_ = "answer_id long, question string, subject string, path string, citations array<string>, evidence array<struct<fact_id: string, point_id: bigint, role: string>>, created_at timestamp"
    rows = [(1, "Why?", None, "short", None, None, None), (2, "Why?", "s", "deep", ["f", "f"], [("f", 5, "direct"), ("g", 6, "supporting")], None), (3, "Why?", "s", "deep", ["g", "x"], [("f", 5, "direct"), ("g", 6, "supporting")], None)]
    got = {r["answer_id"]: (r["quality"], r["points"], r["question_terms"]) for r in trace.traces(spark.createDataFrame(rows, schema_)).collect()}
    assert got == {1: ("gap", [], ""), 2: ("confident", [5], "s"), 3: ("partial", [6], "s")}
