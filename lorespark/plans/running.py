"""Queries of sessions, traces, answers and streams; each stream is run to its end into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import answer, session, study, trace
from lorespark.plans import relational as rel
from lorespark.plans.knowledge import CAND, COOC, _cand
from lorespark.sources.shared import new_folder
from lorespark.streaming import jobs

_OWN: list[str] = []


def query(name: str, names: tuple[str, ...], sql: str | None):
    _OWN.append(name)
    return rel.query(name, names, sql)


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- word lists on turns: every input gets a word of a list, by its place ------------------------

_WORDS = [*tx.REASONING, *tx.INTERRUPT, *tx.CONTINUE, "nothing"]
INPUTS = f"ti AS (SELECT session_id, turn_index, left(coalesce(user_input, ''), 30) || ' ' || ({_list(_WORDS)})[1 + (session_id * 7 + turn_index) % {len(_WORDS)}] || ' ' AS said FROM turns)"


def _inputs(t: DataFrame) -> DataFrame:
    word = F.get(F.array(*map(F.lit, _WORDS)), ((F.col("session_id") * 7 + F.col("turn_index")) % len(_WORDS)).cast("int"))
    return t.select("session_id", "turn_index", F.concat(F.left(F.coalesce("user_input", F.lit("")), F.lit(30)), F.lit(" "), word, F.lit(" ")).alias("said"))


def _any(words: list[str], column: str = "trim(said)") -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({column}, w))) > 0"


@query("FLT20_keywords", ("turns",), f"WITH {INPUTS} SELECT session_id, turn_index, {_any(tx.REASONING, 'said')} AS reasons, {_any(tx.INTERRUPT)} AS stops, turn_index % 2 = 0 AND {_any(tx.CONTINUE)} AS goes_on FROM ti")
def _(t):
    goes_on = F.when(F.col("turn_index") % 2 == 0, "next step").otherwise("")
    return _inputs(t).select("session_id", "turn_index", tx.needs_reasoning(F.col("said")).alias("reasons"), tx.is_interrupt(F.col("said")).alias("stops"), tx.is_continuation(F.col("said"), goes_on).alias("goes_on"))


@query("FUN13_parse_repair", ("turns",), """SELECT session_id, turn_index, CASE WHEN turn_index % 4 = 3 THEN '' ELSE left(said, 50) END AS intent, left(said || said || said, 100) AS subject, left(said, 50) AS audience, turn_index % 4 <> 3 AND said <> '' AS valid
    FROM (SELECT session_id, turn_index, regexp_replace(coalesce(user_input, ''), '[^a-z ]', '', 'g') AS said FROM turns)""")
def _(t):
    said = F.regexp_replace(F.coalesce("user_input", F.lit("")), "[^a-z ]", "")
    rows = t.select("session_id", "turn_index", said.alias("said"))
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.when(F.col("turn_index") % 4 != 3, F.col("said")).alias("intent"), F.concat("said", "said", "said").alias("subject"), F.col("said").alias("audience"))), F.lit(" {}"))
    return rows.select("session_id", "turn_index", session.parsed(reply).alias("p")).select("session_id", "turn_index", "p.intent", "p.subject", "p.audience", "p.valid")


@query("FUN16_topic", ("turns",), "SELECT session_id, turn_index, role || CASE WHEN turn_index % 3 = 0 THEN ' - s' || turn_index WHEN turn_index % 3 = 1 THEN ' - now' ELSE '' END AS topic FROM turns")
def _(t):
    m = F.col("turn_index") % 3
    subject = F.when(m == 0, F.concat(F.lit("s"), F.col("turn_index").cast("string"))).otherwise("")
    return t.select("session_id", "turn_index", tx.topic(F.col("role"), subject, F.when(m == 1, "now")).alias("topic"))


@query("FUN23_small_helpers", ("turns",), """SELECT session_id, turn_index, replace(coalesce(user_input, ''), chr(10), '\\n') AS data, '["' || role || '","' || left(repeat(role, 20), 60) || '","x"]' AS recent, CASE WHEN turn_index % 2 = 0 THEN turn_index ELSE 20 END AS page FROM turns""")
def _(t):
    recent = F.array("role", F.repeat("role", F.lit(20)), F.lit("x"), F.lit("fourth"))
    asked = F.when(F.col("turn_index") % 2 == 0, F.concat(F.lit(" "), F.col("turn_index").cast("string"))).otherwise("many")
    return t.select("session_id", "turn_index", tx.server_event(F.coalesce("user_input", F.lit(""))).alias("data"), tx.recent_subjects(recent).alias("recent"), tx.whole_number(asked, 20).alias("page"))


@query("WIN10_recent_subjects", ("turns",), """SELECT session_id, turn_index, array_to_string(list_slice(seen, greatest(len(seen) - 2, 1), len(seen)), '|') AS recent FROM (
    SELECT session_id, turn_index, list(role || turn_index) OVER (PARTITION BY session_id ORDER BY turn_index) AS seen FROM turns)""")
def _(t):
    out = session.subjects(t, F.lit(False), F.concat("role", F.col("turn_index").cast("string")))
    return out.select("session_id", "turn_index", "recent")


# --- the session machine: events made of turns -----------------------------------------------------

M = "(session_id * 3 + turn_index * 5) % 12"
EVENTS = f"""se AS (SELECT session_id, turn_index, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS n, CASE WHEN m IN (3, 4) THEN 'clarify' WHEN m = 5 THEN 'working' ELSE 'turn' END AS kind,
    CASE WHEN m = 0 THEN '停下 ' || said WHEN m IN (1, 7) THEN '继续' WHEN m = 3 THEN 'r' || turn_index WHEN m = 4 THEN '' WHEN m = 5 THEN 'more of ' || turn_index ELSE said END AS text,
    CASE WHEN m IN (6, 8) THEN '' ELSE left(said, 12) END AS intent, CASE WHEN m IN (2, 9) THEN 's' || turn_index ELSE '' END AS subject
    FROM (SELECT session_id, turn_index, {M} AS m, left(coalesce(user_input, ''), 8 + turn_index % 9) AS said FROM turns))"""


def _events(t: DataFrame) -> DataFrame:
    m = (F.col("session_id") * 3 + F.col("turn_index") * 5) % 12
    n = F.col("turn_index").cast("string")
    said = F.substring(F.coalesce("user_input", F.lit("")), F.lit(1), (F.col("turn_index") % 9 + 8).cast("int"))
    text = F.when(m == 0, F.concat(F.lit("停下 "), said)).when(m.isin(1, 7), "继续").when(m == 3, F.concat(F.lit("r"), n)).when(m == 4, "").when(m == 5, F.concat(F.lit("more of "), n)).otherwise(said)
    kind = F.when(m.isin(3, 4), "clarify").when(m == 5, "working").otherwise("turn")
    return t.select("session_id", "turn_index", kind.alias("kind"), text.alias("text"), F.when(m.isin(6, 8), "").otherwise(F.left(said, F.lit(12))).alias("intent"), F.when(m.isin(2, 9), F.concat(F.lit("s"), n)).otherwise("").alias("subject"))


_BUILT = "CASE WHEN {i} <> '' AND {s} <> '' THEN CASE WHEN contains({i}, {s}) THEN {i} ELSE {s} || ' ' || {i} END ELSE {i} || {s} END"
_STOP, _GOES = _any(tx.INTERRUPT, "trim(e.text)"), f"(r.goes_on <> '' AND {_any(tx.CONTINUE, 'trim(e.text)')})"
_SUBJECT = "CASE WHEN e.subject <> '' THEN e.subject ELSE r.current END"


def _expanded(intent: str, subject: str, text: str) -> str:
    b = _BUILT.format(i=intent, s=subject)
    return f"CASE WHEN r.goes_on <> '' AND {subject} = '' THEN r.goes_on WHEN ({b}) <> '' AND length({text}) < length({b}) THEN ({b}) ELSE {text} END"


MACHINE = f"""{EVENTS}, r AS (
    SELECT session_id, 0::BIGINT AS n, NULL::BIGINT AS turn_index, '' AS action, '' AS expanded, '' AS intent, '' AS subject, '' AS current, []::VARCHAR[] AS recent, '' AS goes_on, '' AS last_reply FROM (SELECT DISTINCT session_id FROM se)
    UNION ALL
    SELECT e.session_id, e.n, e.turn_index,
        CASE WHEN e.kind = 'working' THEN 'noted' WHEN e.kind = 'clarify' THEN CASE WHEN e.text <> '' OR r.current <> '' THEN 'retrieve' ELSE 'skip' END
             WHEN {_STOP} THEN 'interrupted' WHEN {_GOES} THEN 'retrieve' WHEN {_SUBJECT} <> '' OR r.last_reply = 'refused' THEN 'retrieve' ELSE 'clarify' END,
        CASE WHEN e.kind = 'working' THEN '' WHEN e.kind = 'clarify' THEN CASE WHEN e.text <> '' THEN {_expanded('r.intent', 'e.text', "''")} WHEN r.current <> '' THEN {_expanded('r.intent', 'r.current', "''")} ELSE '' END
             WHEN {_STOP} THEN '' WHEN {_GOES} THEN r.goes_on WHEN {_SUBJECT} <> '' OR r.last_reply = 'refused' THEN {_expanded('e.intent', f'({_SUBJECT})', 'e.text')} ELSE '' END,
        CASE WHEN e.kind <> 'turn' OR (NOT {_STOP} AND {_GOES}) THEN r.intent WHEN {_STOP} THEN '' ELSE e.intent END,
        CASE WHEN e.kind = 'clarify' AND e.text <> '' THEN e.text WHEN e.kind <> 'turn' OR (NOT {_STOP} AND {_GOES}) THEN r.subject WHEN {_STOP} THEN '' ELSE e.subject END,
        CASE WHEN e.kind = 'clarify' AND e.text <> '' THEN e.text WHEN e.kind <> 'turn' OR (NOT {_STOP} AND {_GOES}) THEN r.current WHEN {_STOP} THEN '' ELSE {_SUBJECT} END,
        CASE WHEN e.kind <> 'turn' OR (NOT {_STOP} AND {_GOES}) THEN r.recent WHEN {_STOP} THEN [] WHEN e.subject <> '' THEN list_slice(list_append(r.recent, e.subject), greatest(len(r.recent) - 1, 1), 4) ELSE r.recent END,
        CASE WHEN e.kind = 'working' THEN e.text WHEN e.kind = 'turn' AND {_STOP} THEN '' ELSE r.goes_on END,
        CASE WHEN e.kind = 'working' THEN r.last_reply WHEN e.kind = 'clarify' THEN CASE WHEN r.last_reply = '' THEN '' WHEN e.text <> '' THEN 'selected:' || e.text ELSE 'refused' END
             WHEN {_STOP} THEN '' WHEN {_GOES} OR {_SUBJECT} <> '' OR r.last_reply = 'refused' THEN r.last_reply ELSE 'pending' END
    FROM r JOIN se e ON e.session_id = r.session_id AND e.n = r.n + 1)"""
MACHINE_SQL = f"WITH RECURSIVE {MACHINE} SELECT session_id, turn_index, action, expanded, current AS current_subject, array_to_string(recent, '|') AS recent FROM r WHERE n > 0"


@query("STR07_session_replay", ("turns",), MACHINE_SQL)
def _(t):
    return session.replay(_events(t))


@query("STR06_session_stream", ("turns",), MACHINE_SQL)
def _(t):
    """The same as a stream that is stopped and goes on from its checkpoint: first the early turns, then the late ones."""
    spark, at = t.sparkSession, new_folder(t.sparkSession, "session-stream")
    events = _events(t)
    for part in ("turn_index < 3", "turn_index >= 3"):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
        jobs.run_available(jobs.session_machine(jobs.read_stream(spark, f"{at}/in", events.schema)), _numbered(at, part), f"{at}/checkpoint", "append")
    return spark.read.schema(session.OUT).parquet(f"{at}/out").select("session_id", "turn_index", "action", "expanded", "current_subject", "recent")


@query("STR06_from_snapshots", ("turns",), MACHINE_SQL)
def _(t):
    """The same once more: the early turns at once, their sessions' states stored, and a stream of the late ones that begins with these."""
    spark, at = t.sparkSession, new_folder(t.sparkSession, "session-snapshots")
    events = _events(t)
    early = events.filter("turn_index < 3")
    session.snapshots(early).write.parquet(f"{at}/states")
    events.filter("turn_index >= 3").repartition(2).write.parquet(f"{at}/in")
    stream = jobs.session_machine(jobs.read_stream(spark, f"{at}/in", events.schema, 8), spark.read.parquet(f"{at}/states"))
    jobs.run_available(stream, jobs.table_writer(f"{at}/out"), f"{at}/checkpoint", "append")
    return session.replay(early).unionByName(jobs.read_batches(spark, f"{at}/out", session.OUT))


def _numbered(at: str, part: str) -> Callable[[DataFrame, int], None]:
    return jobs.table_writer(f"{at}/out")


# --- answers and traces -----------------------------------------------------------------------------

ANSWERS = """aw AS (SELECT event_id AS answer_id, 'Question ' || user_id || ' about it, again?' AS question, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'topic ' || user_id % 12 END AS subject, CASE WHEN value > 50 THEN 'deep' ELSE 'short' END AS path,
    event_id % 4 < 2 AS has_direct, event_id % 3 < 2 AS has_supporting, event_id % 2 = 0 AS cites_direct, event_id % 5 = 0 AS cites_supporting, event_id % 37 AS direct_point, 100 + event_id % 11 AS supporting_point, ts AS created_at FROM events),
    tr AS (SELECT *, CASE WHEN has_direct AND cites_direct THEN 'confident' WHEN has_supporting THEN 'partial' ELSE 'gap' END AS quality, substr(sha256('question ' || replace(substr(question, 10), ' about it, again?', '') || ' about it again' || chr(31) || subject), 1, 32) AS question_hash,
        CASE WHEN subject <> '' THEN subject ELSE array_to_string(list_sort([replace(substr(question, 10), ' about it, again?', ''), 'about', 'again', 'question']), ' ') END AS question_terms,
        CASE WHEN has_direct AND cites_direct THEN direct_point WHEN has_supporting AND cites_supporting THEN supporting_point END AS point_id FROM aw)"""


def _answers(e: DataFrame) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    fact = lambda name, point, role: F.struct(F.lit(name).alias("fact_id"), point.cast("bigint").alias("point_id"), F.lit(role).alias("role"))
    evidence = F.array_compact(F.array(F.when(i % 4 < 2, fact("d", i % 37, "direct")), F.when(i % 3 < 2, fact("s", i % 11 + 100, "supporting"))))
    cited = F.array_compact(F.array(F.when(i % 2 == 0, "d"), F.when(i % 5 == 0, "s"), F.when(i % 5 == 0, "s"), F.lit("unknown")))
    return e.select(
        i.alias("answer_id"), F.concat(F.lit("Question "), u.cast("string"), F.lit(" about it, again?")).alias("question"), F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("topic "), (u % 12).cast("string"))).alias("subject"),
        F.when(F.col("value") > 50, "deep").otherwise("short").alias("path"), cited.alias("citations"), F.when(F.size(evidence) > 0, evidence).alias("evidence"), F.col("ts").alias("created_at"),
    )


@query("TRC01_grade", ("events",), f"WITH {ANSWERS} SELECT answer_id, quality FROM tr")
def _(e):
    return trace.traces(_answers(e)).select("answer_id", "quality")


@query("TRC02_process", ("events",), f"WITH {ANSWERS} SELECT answer_id, question_hash, question_terms, quality, path, CASE WHEN has_direct AND cites_direct THEN direct_point::VARCHAR ELSE '' END AS direct, coalesce(point_id::VARCHAR, '') AS points FROM tr")
def _(e):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return trace.traces(_answers(e)).select("answer_id", "question_hash", "question_terms", "quality", "path", text("direct").alias("direct"), text("points").alias("points"))


@query("TRC02_cooccurrence", ("events",), f"""WITH {ANSWERS}, f AS (SELECT *, row_number() OVER (PARTITION BY question_hash, point_id ORDER BY created_at, answer_id) AS r FROM tr WHERE point_id IS NOT NULL)
    SELECT question_terms, point_id, count(*) AS hit_count, count_if(quality = 'confident') AS confident_count FROM f WHERE r = 1 GROUP BY ALL""")
def _(e):
    return trace.cooccurrence(trace.traces(_answers(e))).drop("last_seen_at")


@query("TRC02_events", ("events",), f"""WITH {ANSWERS} SELECT answer_id AS trace_id, 'knowledge_gap' AS event_type, '{{"question":"' || question || '"}}' AS payload FROM tr WHERE quality = 'gap'""")
def _(e):
    return trace.learning_events(trace.traces(_answers(e)))


@query("ANS04_saved_answers", ("events",), f"WITH {ANSWERS} SELECT quality, count(*) AS n, 'v1' AS prompt_version FROM tr GROUP BY 1")
def _(e):
    """Answers are appended in two goes; a stream grades what has arrived each time, every answer once."""
    spark, at = e.sparkSession, new_folder(e.sparkSession, "answers")
    rows = _answers(e)
    for part in ("answer_id % 2 = 0", "answer_id % 2 = 1"):
        answer.save(rows.filter(part), f"{at}/in", "v1", "plain")
        schema = spark.read.parquet(f"{at}/in").schema
        stream = jobs.read_stream(spark, f"{at}/in", schema, 64)
        jobs.run_available(trace.traces(stream).select("answer_id", "quality").withColumn("prompt_version", F.lit("v1")), jobs.table_writer(f"{at}/out"), f"{at}/checkpoint", "append")
    return jobs.read_batches(spark, f"{at}/out", "answer_id bigint, quality string, prompt_version string").groupBy("quality", "prompt_version").agg(F.count("*").alias("n"))


@query("ANS01_route", ("events",), f"""WITH {ANSWERS}, x AS (SELECT *, question || CASE WHEN answer_id % 6 = 0 THEN ' 为什么' ELSE '' END AS asked FROM tr)
    SELECT answer_id, CASE WHEN NOT has_direct AND NOT has_supporting THEN 'none' WHEN answer_id % 7 = 0 OR {_any(tx.REASONING, 'asked')} OR NOT has_direct THEN 'deep' ELSE 'short' END AS route FROM x""")
def _(e):
    rows = _answers(e).withColumn("asked", F.concat("question", F.when(F.col("answer_id") % 6 == 0, " 为什么").otherwise("")))
    direct = F.size(F.filter(F.coalesce("evidence", F.array().cast("array<struct<fact_id:string,point_id:bigint,role:string>>")), lambda x: x["role"] == "direct"))
    return rows.select("answer_id", answer.route(F.size(F.coalesce("evidence", F.array().cast("array<struct<fact_id:string,point_id:bigint,role:string>>"))), direct, tx.needs_reasoning(F.col("asked")), F.col("answer_id") % 7 == 0).alias("route"))


def _words(request: str):
    """A provider that streams the question's words, and breaks off on one."""
    import json

    for word in json.loads(request)["question"].split(" "):
        if word == "KINGDOM":
            raise OSError
        yield word + " "


def _streamed(c: DataFrame, what: Callable[[int, str], list[tuple]], schema: str) -> DataFrame:
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([x for i, name in rows.itertuples(index=False) for x in what(i, name)], columns=names)

    return c.select("concept_id", "name").mapInPandas(run, schema)


def _phases(i: int, name: str):
    return answer.stream(f"about {name}", [] if i % 5 == 0 else [{"id": "e", "content": name}], _words)


PARTS = "cw AS (SELECT concept_id, string_split('about ' || name, ' ') AS w, concept_id % 5 = 0 AS empty FROM concepts)"


@query("ANS03_streamed_answer", ("concepts",), f"""WITH {PARTS} SELECT concept_id, CASE WHEN NOT empty AND list_contains(w, 'KINGDOM') THEN 'failed' ELSE 'done' END AS phase, CASE WHEN empty THEN 0 ELSE coalesce(nullif(list_position(w, 'KINGDOM'), 0) - 1, len(w)) END AS chunks,
    CASE WHEN empty THEN 'No evidence was found for this question.' WHEN list_contains(w, 'KINGDOM') THEN 'The answer could not be made; please try again.' ELSE array_to_string(w, ' ') || ' ' END AS said FROM cw""")
def _(c):
    def what(i: int, name: str) -> list[tuple]:
        events = list(_phases(i, name))
        return [(i, events[-1][0], sum(p == "chunk" for p, _ in events), events[-1][1])]

    return _streamed(c, what, "concept_id bigint, phase string, chunks bigint, said string")


@query("STR08_server_events", ("concepts",), f"""WITH {PARTS} SELECT concept_id, 'event: started' || chr(10) || 'data: ' || chr(10) || chr(10) || CASE WHEN empty THEN 'event: done' || chr(10) || 'data: No evidence was found for this question.' ELSE
    array_to_string(list_transform(list_slice(w, 1, coalesce(nullif(list_position(w, 'KINGDOM'), 0) - 1, len(w))::INT), lambda x: 'event: chunk' || chr(10) || 'data: ' || x || ' ' || chr(10) || chr(10)), '') ||
    CASE WHEN list_contains(w, 'KINGDOM') THEN 'event: failed' || chr(10) || 'data: The answer could not be made; please try again.' ELSE 'event: done' || chr(10) || 'data: ' || array_to_string(w, ' ') || ' ' END END || chr(10) || chr(10) AS stream FROM cw""")
def _(c):
    return _streamed(c, lambda i, name: [(i, "".join(answer.delivered(_phases(i, name))))], "concept_id bigint, stream string")


# --- gaps: learning events joined with their traces -----------------------------------------------

LEARNING = """le AS (SELECT answer_id AS event_id, answer_id AS trace_id, '{"question":"' || question || '"}' AS payload FROM tr WHERE quality = 'gap'), kt AS (SELECT answer_id AS trace_id, CASE WHEN answer_id % 13 = 0 THEN '' ELSE question_terms END AS question_terms FROM tr)"""


def _learning(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    done = trace.traces(_answers(e))
    events = trace.learning_events(done).select(F.col("trace_id").alias("event_id"), "trace_id", "payload")
    return events, done.select(F.col("answer_id").alias("trace_id"), F.when(F.col("answer_id") % 13 == 0, "").otherwise(F.col("question_terms")).alias("question_terms"))


@query("JOI02_gap_payload", ("events",), f"WITH {ANSWERS}, {LEARNING} SELECT event_id, question_terms, json_extract_string(payload, '$.question') AS question FROM le JOIN kt USING (trace_id)")
def _(e):
    events, known = _learning(e)
    return events.join(known, "trace_id").select("event_id", "question_terms", F.get_json_object("payload", "$.question").alias("question"))


GAPS = f"""{ANSWERS}, {LEARNING}, ge AS (SELECT *, json_extract_string(payload, '$.question') AS question FROM le JOIN kt USING (trace_id) WHERE question_terms <> '')"""


@query("AGG12_gaps", ("events",), f"""WITH {GAPS} SELECT question_terms, count(*) AS hit_count, arg_max(question, event_id) AS question, count_if(event_id % 2 = 0) < 3 AND count(*) >= 3 AND count_if(event_id % 2 = 1) > 0 AS crossed FROM ge GROUP BY 1""")
def _(e):
    """Two runs of the study cycle; ``crossed`` tells which gaps reached three hits in the second one."""
    events, known = _learning(e)
    first = trace.gap_counts(e.sparkSession.createDataFrame([], "question_terms string, hit_count bigint, question string"), events.filter("event_id % 2 = 0"), known, 3)
    second = trace.gap_counts(first.drop("crossed"), events.filter("event_id % 2 = 1"), known, 3)
    both = second.join(first.select("question_terms", F.col("question").alias("_before")), "question_terms", "left")
    latest = events.join(known, "trace_id").groupBy("question_terms").agg(F.max_by(F.get_json_object("payload", "$.question"), "event_id").alias("question"))
    return both.drop("question", "_before").join(latest, "question_terms").select("question_terms", "hit_count", "question", "crossed")


@query("STR05_gap_stream", ("events",), f"WITH {GAPS} SELECT question_terms, count(*) AS hit_count, (SELECT count(*) FROM le) AS processed FROM ge GROUP BY 1")
def _(e):
    """Gap events as a stream in several micro-batches: each counts once and is marked."""
    spark, at = e.sparkSession, new_folder(e.sparkSession, "gap-stream")
    events, known = _learning(e)
    events.repartition(3).write.parquet(f"{at}/in")
    known.write.parquet(f"{at}/traces")
    jobs.run_available(jobs.read_stream(spark, f"{at}/in", events.schema), jobs.gap_writer(at, spark.read.parquet(f"{at}/traces"), 3), f"{at}/checkpoint", "append")
    marked = spark.read.parquet(f"{at}/processed").select("event_id").distinct()
    after = spark.read.parquet(f"{at}/gaps")
    return after.filter(F.col("after") == after.agg(F.max("after")).first()[0]).select("question_terms", "hit_count", F.lit(marked.count()).alias("processed"))


# --- streams -----------------------------------------------------------------------------------------


@query("STR01_task_queue", ("events",), """SELECT event_type AS task_type, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'failed' WHEN event_type = 'click' AND value > 90 THEN 'failed' ELSE 'done' END AS status, count(*) AS n,
    count_if(event_type NOT IN ('view', 'click', 'purchase')) AS without_handler FROM events GROUP BY ALL""")
def _(e):
    """Tasks of three types with handlers, and others, in micro-batches of bounded size; a task that breaks a rule fails alone."""
    spark, at = e.sparkSession, new_folder(e.sparkSession, "tasks")
    tasks = e.select(F.col("event_id").alias("task_id"), F.col("event_type").alias("task_type"), F.col("value").cast("double").alias("payload"))
    tasks.repartition(4).write.parquet(f"{at}/in")
    fine = lambda rows: rows.select("task_id", F.lit(None).cast("string").alias("error"))
    strict = lambda rows: rows.select("task_id", F.when(F.col("payload") > 90, "too large").alias("error"))
    done = jobs.handle_tasks(jobs.read_stream(spark, f"{at}/in", tasks.schema, 2), {"view": fine, "click": strict, "purchase": fine})
    jobs.run_available(done, jobs.table_writer(f"{at}/out"), f"{at}/checkpoint", "append")
    out = jobs.read_batches(spark, f"{at}/out", "task_id bigint, task_type string, status string, error string")
    return out.groupBy("task_type", "status").agg(F.count("*").alias("n"), F.count_if(F.col("error") == "no handler").alias("without_handler"))


@query("STR02_scheduled_runs", ("events",), "SELECT 2 AS runs, count(*) AS events FROM events")
def _(e):
    """A job that a schedule starts twice: each run takes what is new, so that together they take all once."""
    import threading

    spark, at = e.sparkSession, new_folder(e.sparkSession, "schedule")
    done = threading.Event()
    taken: list[int] = []

    def run(_: int) -> None:
        if len(taken) < 2:
            half = len(taken)
            e.filter(F.col("event_id") % 2 == half).select("event_id").coalesce(1).write.mode("append").parquet(f"{at}/in")
            jobs.run_available(jobs.read_stream(spark, f"{at}/in", "event_id bigint", 8), jobs.table_writer(f"{at}/out"), f"{at}/checkpoint", "append")
            taken.append(half)
        if len(taken) == 2:
            done.set()

    ticks = jobs.every(spark, run, "1 second", f"{at}/ticks")
    done.wait(600)
    ticks.stop()
    out = spark.read.parquet(f"{at}/out")
    return out.agg(F.count_distinct("batch").cast("int").alias("runs"), F.count("event_id").alias("events"))


SOURCES = ("view", "click", "purchase", "error", "signup")


@query("STR03_progress", ("events",), "SELECT k AS source, count(*) FILTER (WHERE event_type = k) AS read, count(*) FILTER (WHERE event_type = k AND value > 20) AS kept FROM events, (VALUES ('view'), ('click'), ('purchase'), ('error'), ('signup')) v(k) GROUP BY k")
def _(e):
    """What a listener hears of the stages of a stream, by source: rows that were read, and those that a filter kept."""
    import time

    spark, at = e.sparkSession, new_folder(e.sparkSession, "progress")
    e.select("event_id", "event_type", "value").repartition(3).write.parquet(f"{at}/in")
    heard = jobs.Progress()
    spark.streams.addListener(heard)
    by_source = tuple(f"{k}=event_type = '{k}'" for k in SOURCES)
    try:
        read = jobs.observed(jobs.read_stream(spark, f"{at}/in", "event_id bigint, event_type string, value double"), "read", by_source)
        jobs.run_available(jobs.observed(read.filter("value > 20"), "kept", by_source), jobs.table_writer(f"{at}/out"), f"{at}/checkpoint", "append")
        for _ in range(100):  # events come a little later
            if heard.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    found = heard.stages()
    return spark.createDataFrame([(k, found["read", k], found["kept", k]) for k in SOURCES], "source string, read long, kept long")


@query("STR04_counted_once", ("traces",), "SELECT question_terms, point_id, count(*) AS hit_count FROM (SELECT DISTINCT question_hash, point_id, question_terms FROM (SELECT *, row_number() OVER (PARTITION BY question_hash, point_id ORDER BY question_terms) AS r FROM traces) WHERE r = 1) GROUP BY ALL")
def _(t):
    """Each (question, point) counts once in a stream that holds every trace twice. Terms follow from the question here."""
    spark, at = t.sparkSession, new_folder(t.sparkSession, "counts")
    terms = t.groupBy("question_hash", "point_id").agg(F.min("question_terms").alias("question_terms"))
    rows = t.drop("question_terms").join(terms, ["question_hash", "point_id"]).select("question_hash", "point_id", "question_terms")
    rows.unionByName(rows).repartition(3).write.parquet(f"{at}/in")
    jobs.run_available(jobs.first_sights(jobs.read_stream(spark, f"{at}/in", rows.schema)), jobs.table_writer(f"{at}/out"), f"{at}/checkpoint", "append")
    return jobs.read_batches(spark, f"{at}/out", rows.schema).groupBy("question_terms", "point_id").agg(F.count("*").alias("hit_count"))


# --- the study cycle -----------------------------------------------------------------------------------

REPORT = f"""WITH {COOC}, {CAND}, s AS (SELECT count(*) AS total, count_if(quality = 'confident') AS confident, count_if(quality = 'partial') AS partial, count_if(quality = 'gap') AS gap, round(coalesce(count_if(quality = 'confident') / nullif(count(*), 0), 0), 6) AS confident_rate
    FROM traces WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 DAY), g AS (SELECT question_terms, count(*) AS hit_count FROM traces WHERE quality = 'gap' AND question_terms <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
    j AS (SELECT '[' || string_agg('{{"question_terms":"' || question_terms || '","hit_count":' || hit_count || '}}', ',' ORDER BY question_terms, hit_count) || ']' AS gaps FROM g)"""


@query("STD01_report", ("traces",), f"{REPORT} SELECT s.*, (SELECT count(*) FROM cand) AS n_candidates, gaps FROM s, j")
def _(t):
    top = study.gaps(t).orderBy(F.desc("hit_count"), "question_terms").limit(20)
    return study.report(study.trace_summary(t, "2024-01-20 00:00:00", 30), _cand(t), top)


@query("AGG20_report_document", ("traces",), f"""{REPORT}, b AS (SELECT point_id, count(DISTINCT question_terms) AS breadth FROM cooc WHERE confident_count > 0 GROUP BY 1), p AS (SELECT point_id, round(avg(CASE WHEN path = 'short' THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_rate FROM traces WHERE quality = 'confident' GROUP BY 1)
    SELECT (SELECT total FROM s) AS total, (SELECT len(from_json(gaps, '["JSON"]')) FROM j) AS n_gaps, count(*) AS n_candidates, count_if(round(confident_count / hit_count, 6) >= 0.7 AND coalesce(breadth, 0) >= 3 AND coalesce(short_rate, 0) >= 0.6) AS n_strong, 2 AS kept FROM cand LEFT JOIN b USING (point_id) LEFT JOIN p USING (point_id)""")
def _(t):
    """Reports as stored documents, of three runs the newest two kept; the newest is read back."""
    spark, at = t.sparkSession, new_folder(t.sparkSession, "reports")
    links = study.recommend(_cand(t), study.cooccurrence(t), t)
    top = study.gaps(t).orderBy(F.desc("hit_count"), "question_terms").limit(20)
    document = study.report_document(study.trace_summary(t, "2024-01-20 00:00:00", 30), links, top)
    for _ in range(3):
        study.save_report(document, f"{at}/reports", keep=2)
    kept = study.reports(spark, f"{at}/reports")
    schema = "summary struct<total: bigint>, links array<struct<recommendation: string>>, gaps array<struct<question_terms: string>>"
    d = F.from_json("content", schema)
    newest = kept.orderBy(F.desc("version")).limit(1).select(d.alias("d"))
    n = kept.count()
    return newest.select("d.summary.total", F.size("d.gaps").cast("bigint").alias("n_gaps"), F.size("d.links").cast("bigint").alias("n_candidates"), F.size(F.filter("d.links", lambda x: x["recommendation"] == "strong")).cast("bigint").alias("n_strong"), F.lit(n).cast("int").alias("kept"))


@query("SRT02_candidates", ("traces",), f"WITH {COOC} SELECT question_terms, point_id, confident_count FROM cooc ORDER BY confident_count DESC, question_terms, point_id LIMIT 200")
def _(t):
    return study.candidates(study.cooccurrence(t), 0, 0.0, 200).select("question_terms", "point_id", "confident_count")


@query("SRT11_capped", ("traces",), f"WITH {COOC}, {CAND} SELECT question_terms, point_id FROM cand ORDER BY question_terms, point_id LIMIT 25")
def _(t):
    from lorespark.operators import store

    return store.listing(_cand(t), {}, [F.col("question_terms"), F.col("point_id")], 25).select("question_terms", "point_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: rel.QUERIES.pop(n) for n in _OWN}
SQL: dict[str, str] = {n: rel.SQL.pop(n) for n in _OWN if n in rel.SQL}
