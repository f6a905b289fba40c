"""Queries over the store's tables: scans, filters, joins, changes, top-k, set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import session, store
from lorespark.sources import versions
from lorespark.sources.shared import new_folder
from lorespark.plans.model import ctes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, names: tuple[str, ...], sql: str | None):
    """Registers a function of (tables by name) under ``name``, with the oracle's SQL after the tables' definitions."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, n) for n in names))

        QUERIES[name] = run
        if sql is not None:
            from lorespark.plans.model import DERIVED

            derived = [n for n in names if n in DERIVED]
            body = sql.strip()
            if not derived:
                SQL[name] = body
            elif body.upper().startswith("WITH RECURSIVE "):
                SQL[name] = "WITH RECURSIVE" + ctes(*derived).rstrip()[4:] + ", " + body[15:]
            elif body.upper().startswith("WITH "):
                SQL[name] = ctes(*derived).rstrip() + ", " + body[5:]
            else:
                SQL[name] = ctes(*derived) + body
        return f

    return wrap


D3 = "('src1', 'src2', 'src3')"


@query("SRC02_file_format", ("sources",), """SELECT source_id, CASE source_id % 6 WHEN 0 THEN 'word' WHEN 1 THEN 'pdf' WHEN 2 THEN 'markdown' WHEN 3 THEN 'image' WHEN 4 THEN 'other' ELSE 'other' END AS format FROM sources""")
def _(s):
    ext = F.element_at(F.array(*map(F.lit, (".docx", ".PDF", ".md", ".tiff", ".rtf", ".xyz"))), (F.pmod("source_id", F.lit(6)) + 1).cast("int"))
    return s.select("source_id", tx.file_format(F.concat(F.lit("file.v2"), ext)).alias("format"))


@query("SRC05_line_range", ("sources",), "SELECT source_id, coalesce(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), '') AS body FROM sources")
def _(s):
    return s.select("source_id", tx.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("body"))


@query("SRC06_numbered_lines", ("sources",), "SELECT source_id, string_agg('[' || i || '] ' || l[i], chr(10) ORDER BY i) AS body FROM (SELECT source_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, string_split(text, chr(10)) AS l FROM sources)) GROUP BY source_id")
def _(s):
    return s.select("source_id", tx.numbered_lines(F.col("text")).alias("body"))


@query("SRC11_domains_by_name", ("domains",), "SELECT domain_id, name FROM domains")
def _(d):
    return d.orderBy("name")


@query("SNK03_upsert_replace", ("points",), "SELECT point_id, CASE WHEN point_id % 3 = 0 THEN 'new' ELSE content END AS content FROM points UNION ALL SELECT -1, 'new'")
def _(p):
    new = p.filter("point_id % 3 = 0").select("point_id", F.lit("new").alias("content")).unionByName(p.sparkSession.createDataFrame([(-1, "new")], "point_id long, content string"))
    return store.upsert_replace(p.select("point_id", "content"), new, ["point_id"])


@query("SNK04_upsert_add", ("traces",), """SELECT question_terms, count(*)::BIGINT AS hit_count, arg_max(question, (created_at, trace_id)) AS question FROM traces WHERE quality = 'gap' GROUP BY question_terms""")
def _(t):
    def part(x):
        return x.groupBy("question_terms").agg(F.count("*").alias("hit_count"), F.max_by("question", F.struct("created_at", "trace_id")).alias("question"), F.max(F.struct("created_at", "trace_id")).alias("_at"))

    from lorespark.operators.study import gaps

    day = F.lit("2024-01-15").cast("timestamp")
    bad = t.filter("quality = 'gap'")
    return store.upsert_add(gaps(bad.filter(F.col("created_at") < day)), gaps(bad.filter(F.col("created_at") >= day)), ["question_terms"], "hit_count", ["question"])


@query("SNK06_delete_cascade", ("units", "points", "relations"), """WITH gone AS (SELECT point_id FROM points WHERE unit_id IN (SELECT unit_id FROM units WHERE source_id IN (3, 5)))
    SELECT relation_id, source_point, target_point FROM relations WHERE source_point NOT IN (SELECT point_id FROM gone) AND target_point NOT IN (SELECT point_id FROM gone)""")
def _(u, p, r):
    """Over a store in versions: a cascade that is broken off after its first table leaves the old version, the next one appears in all tables at once."""
    spark = u.sparkSession
    ids = spark.createDataFrame([(3,), (5,)], "source_id long")
    before = versions.open_version(spark, new_folder(spark, "store")).commit({"units": u, "points": p, "relations": r})

    class Broken(Exception): ...

    def fails(_) -> None:
        raise Broken

    after = store.delete_cascade({"units": u, "points": p, "relations": r}, ids)
    try:
        before.commit({"units": after["units"]}, {"units": fails})
    except Broken:
        pass
    if versions.open_version(spark, before.root).tables != before.tables:
        raise AssertionError("a broken commit shows")
    before.commit(after)
    return versions.open_version(spark, before.root).table("relations").select("relation_id", "source_point", "target_point")


@query("SNK10_keep_newest", ("traces",), "SELECT trace_id, created_at FROM traces ORDER BY created_at DESC, trace_id DESC LIMIT 10")
def _(t):
    return store.keep_newest(t.select("trace_id", "created_at"), 10, [F.desc("created_at"), F.desc("trace_id")])


@query("SNK11_latest_open_turn", ("turns",), "SELECT session_id, max(turn_index) AS turn_index FROM turns WHERE answer_id IS NULL GROUP BY session_id")
def _(t):
    return store.latest_open(t).select("session_id", "turn_index")


@query("SNK12_next_turn", ("turns",), "SELECT session_id, coalesce(max(turn_index), 0) + 1 AS next_index FROM turns GROUP BY session_id")
def _(t):
    return store.next_turn_index(t)


@query("SNK13_delete_sessions", ("turns",), "SELECT session_id, turn_index FROM turns WHERE session_id % 10 <> 0")
def _(t):
    gone = t.filter("session_id % 10 = 0").select("session_id").distinct()
    return t.join(gone, "session_id", "left_anti").select("session_id", "turn_index")


@query("FLT01_domain_filter", ("sources",), f"SELECT source_id, domain_id FROM sources WHERE domain_id IN {D3} OR domain_id IS NULL")
def _(s):
    return store.in_domains(s.select("source_id", "domain_id"), ["src1", "src2", "src3"])


@query("FLT03_choose_or_all", ("sources",), "SELECT source_id, true AS any_hit FROM sources WHERE source_id IN (4, 8, 15) UNION ALL SELECT source_id, false FROM sources")
def _(s):
    spark = s.sparkSession
    some = store.choose(s.select("source_id"), spark.createDataFrame([(4,), (8,), (15,), (-9,)], "source_id long"), "source_id").withColumn("any_hit", F.lit(True))
    none = store.choose(s.select("source_id"), spark.createDataFrame([(-9,)], "source_id long"), "source_id").withColumn("any_hit", F.lit(False))
    return some.unionByName(none)


@query("FLT04_list_sources", ("sources",), "SELECT source_id, status FROM sources WHERE status = 'completed' ORDER BY source_id DESC LIMIT 20 OFFSET 10")
def _(s):
    return store.listing(s.select("source_id", "status", "domain_id"), {"status": "completed", "domain_id": None}, [F.desc("source_id")], 20, 10).select("source_id", "status")


@query("FLT05_list_traces", ("traces",), "SELECT trace_id, quality FROM traces WHERE quality = 'gap' ORDER BY created_at DESC, trace_id LIMIT 50")
def _(t):
    return store.listing(t, {"quality": "gap"}, [F.desc("created_at"), F.col("trace_id")], 50).select("trace_id", "quality")


@query("FLT10_look_back", ("traces",), "SELECT trace_id FROM traces WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY")
def _(t):
    return t.filter(F.col("created_at") >= F.expr("timestamp '2024-01-20 00:00:00' - interval 5 days")).select("trace_id")


@query("FLT12_points_of_units", ("units", "points"), "SELECT point_id, unit_id FROM points WHERE unit_id IN (SELECT unit_id FROM units WHERE status = 'completed' AND source_id IN (1, 2, 3))")
def _(u, p):
    ids = u.filter("status = 'completed' AND source_id IN (1, 2, 3)").select("unit_id")
    return p.join(ids, "unit_id", "left_semi").select("point_id", "unit_id")


@query("FLT13_has_neighbours", ("units", "relations"), "SELECT unit_id, (unit_id IN (SELECT source_point FROM relations) OR unit_id IN (SELECT target_point FROM relations)) AS has_neighbours FROM units")
def _(u, r):
    ends = r.select(F.col("source_point").alias("unit_id")).unionByName(r.select(F.col("target_point").alias("unit_id"))).distinct().withColumn("has", F.lit(True))
    return u.join(ends, "unit_id", "left").select("unit_id", F.coalesce("has", F.lit(False)).alias("has_neighbours"))


@query("FLT18_valid_relations", ("units", "relations"), """SELECT relation_id, 'bidirectional' AS direction FROM relations WHERE source_point IN (SELECT unit_id FROM units) AND target_point IN (SELECT unit_id FROM units)
    AND source_point <> target_point AND relation_type IN ('related', 'contradicts')""")
def _(u, r):
    a, b = u.select(F.col("unit_id").alias("source_point")), u.select(F.col("unit_id").alias("target_point"))
    ok = r.join(a, "source_point", "left_semi").join(b, "target_point", "left_semi").filter("source_point <> target_point AND relation_type IN ('related', 'contradicts')")
    return ok.select("relation_id", F.lit("bidirectional").alias("direction"))


@query("PRJ01_other_end", ("relations",), "SELECT relation_id, CASE WHEN source_point = 7 THEN target_point ELSE source_point END AS other, source_point = 7 AS as_source FROM relations WHERE source_point = 7 OR target_point = 7")
def _(r):
    return r.filter("source_point = 7 OR target_point = 7").select("relation_id", F.when(F.col("source_point") == 7, F.col("target_point")).otherwise(F.col("source_point")).alias("other"), (F.col("source_point") == 7).alias("as_source"))


@query("PRJ02_unit_with_points", ("units", "points"), "SELECT unit_id, coalesce(string_agg(point_id::VARCHAR, ',' ORDER BY point_id), '') AS points FROM units LEFT JOIN points USING (unit_id) GROUP BY unit_id")
def _(u, p):
    own = p.groupBy("unit_id").agg(F.array_sort(F.collect_list("point_id")).alias("ids"))
    return u.join(own, "unit_id", "left").select("unit_id", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("points"))


@query("JOI01_completed_points", ("points", "units"), "SELECT point_id, center FROM points JOIN units USING (unit_id) WHERE status = 'completed'")
def _(p, u):
    return p.join(u.filter("status = 'completed'"), "unit_id").select("point_id", "center")


@query("JOI03_candidate_concepts", ("points", "units", "concepts"), "SELECT point_id, center, coalesce(c.name, '') AS concept FROM points JOIN units u USING (unit_id) LEFT JOIN concepts c ON u.concept_id = c.concept_id")
def _(p, u, c):
    return p.join(u, "unit_id").join(c, "concept_id", "left").select("point_id", "center", F.coalesce("name", F.lit("")).alias("concept"))


@query("JOI05_answered_sessions", ("turns",), "SELECT DISTINCT session_id FROM turns t WHERE EXISTS (SELECT 1 FROM turns x WHERE x.session_id = t.session_id AND x.answer_id IS NOT NULL)")
def _(t):
    return t.select("session_id").distinct().join(t.filter("answer_id IS NOT NULL").select("session_id"), "session_id", "left_semi")


SEEDS = "(SELECT unit_id AS point_id FROM units WHERE source_id = 2)"


@query("JOI06_neighbours", ("units", "relations"), f"""SELECT target_point AS point_id FROM relations WHERE relation_type <> 'contradicts' AND source_point IN {SEEDS}
    UNION SELECT source_point FROM relations WHERE relation_type <> 'contradicts' AND direction = 'bidirectional' AND target_point IN {SEEDS}""")
def _(u, r):
    return store.neighbours(r, u.filter("source_id = 2").select(F.col("unit_id").alias("point_id")))


@query("JOI07_conflicts", ("units", "relations"), f"""SELECT target_point AS point_id FROM relations WHERE relation_type = 'contradicts' AND source_point IN {SEEDS}
    UNION SELECT source_point FROM relations WHERE relation_type = 'contradicts' AND target_point IN {SEEDS}""")
def _(u, r):
    return store.conflicts(r, u.filter("source_id = 2").select(F.col("unit_id").alias("point_id")))


@query("JOI15_closure", ("customer",), """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey <= 3 THEN NULL ELSE c_custkey // 3 END AS parent FROM customer),
    r AS (SELECT id FROM n WHERE id IN (2, 3) UNION SELECT n.id FROM n JOIN r ON n.parent = r.id) SELECT id FROM r""")
def _(c):
    nodes = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 3, F.floor(F.col("c_custkey") / 3)).alias("parent"))
    return store.closure(nodes, "id", "parent", nodes.filter("id IN (2, 3)"))


@query("FLT14_leaves", ("customer",), "WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey <= 3 THEN NULL ELSE c_custkey // 3 END AS parent FROM customer) SELECT id FROM n WHERE id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)")
def _(c):
    nodes = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 3, F.floor(F.col("c_custkey") / 3)).alias("parent"))
    return store.leaves(nodes, "id", "parent").select("id")


@query("SET03_insert_missing", ("concepts",), "SELECT concept_id, name FROM concepts UNION ALL SELECT 99, 'EXTRA'")
def _(c):
    old = c.select("concept_id", "name")
    new = old.limit(0).unionByName(c.sparkSession.createDataFrame([(1, "ignored"), (99, "EXTRA"), (99, "EXTRA")], "concept_id long, name string"))
    return store.insert_missing(old, new, ["concept_id"])


@query("SET06_new_neighbours", ("units", "relations"), f"""SELECT point_id FROM (SELECT target_point AS point_id FROM relations WHERE relation_type <> 'contradicts' AND source_point IN {SEEDS}
    UNION SELECT source_point FROM relations WHERE relation_type <> 'contradicts' AND direction = 'bidirectional' AND target_point IN {SEEDS}) WHERE point_id NOT IN {SEEDS}""")
def _(u, r):
    seeds = u.filter("source_id = 2").select(F.col("unit_id").alias("point_id"))
    return store.neighbours(r, seeds).join(seeds, "point_id", "left_anti")


@query("SRT03_top_gaps", ("traces",), "SELECT question_terms, count(*)::BIGINT AS hit_count FROM traces WHERE quality = 'gap' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return t.filter("quality = 'gap'").groupBy("question_terms").agg(F.count("*").alias("hit_count")).orderBy(F.desc("hit_count"), "question_terms").limit(20)


@query("SRT06_latest", ("traces",), "SELECT trace_id, created_at FROM traces ORDER BY created_at DESC, trace_id DESC LIMIT 1")
def _(t):
    return t.agg(F.max(F.struct("created_at", "trace_id")).alias("m")).select("m.trace_id", "m.created_at")


@query("WIN11_subjects", ("turns",), """WITH s AS (SELECT session_id, turn_index, turn_index % 5 = 3 AS stop, CASE WHEN turn_index % 2 = 0 AND turn_index % 5 <> 3 THEN 's' || turn_index END AS subject FROM turns),
    e AS (SELECT *, sum(stop::INT) OVER (PARTITION BY session_id ORDER BY turn_index) AS epoch FROM s),
    c AS (SELECT session_id, turn_index, epoch, last_value(subject IGNORE NULLS) OVER w AS current_subject, list(subject) FILTER (WHERE subject IS NOT NULL) OVER w AS seen FROM e WINDOW w AS (PARTITION BY session_id, epoch ORDER BY turn_index))
    SELECT session_id, turn_index, epoch::BIGINT AS epoch, current_subject, coalesce(array_to_string(list_slice(seen, greatest(len(seen) - 2, 1), len(seen)), '|'), '') AS recent FROM c""")
def _(t):
    return session.subjects(t, F.col("turn_index") % 5 == 3, F.when(F.col("turn_index") % 2 == 0, F.concat(F.lit("s"), F.col("turn_index").cast("string"))).otherwise(F.lit("")))


@query("WIN16_fixed_batches", ("points",), "SELECT point_id, (row_number() OVER (PARTITION BY unit_id ORDER BY point_id) - 1) // 60 AS batch FROM points")
def _(p):
    r = F.row_number().over(W.partitionBy("unit_id").orderBy("point_id"))
    return p.select("point_id", F.floor((r - 1) / 60).cast("bigint").alias("batch"))


@query("FUN01_normalise", ("benchmark",), r"SELECT item_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[^\p{L}\p{Nd} ]', '', 'g')) AS normal FROM benchmark")
def _(b):
    return b.select("item_id", tx.normalise_question(F.col("text")).alias("normal"))


@query("FUN07_keywords", ("sources",), "SELECT source_id, trim(regexp_replace(translate(title, ',;', '  '), ' +', ' ', 'g')) AS keywords FROM sources")
def _(s):
    return s.select("source_id", tx.normalise_keywords(F.col("title")).alias("keywords"))


@query("FUN09_first_paragraph", ("sources",), """SELECT source_id, left(coalesce(string_agg(l || chr(10), '' ORDER BY i) FILTER (WHERE l <> '' AND NOT starts_with(l, '#')), ''), 300) AS paragraph
    FROM (SELECT source_id, i, trim(a[i]) AS l FROM (SELECT source_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT source_id, string_split(text, chr(10)) AS a FROM sources))) GROUP BY source_id""")
def _(s):
    return s.select("source_id", tx.first_paragraph(F.col("text")).alias("paragraph"))


@query("FUN10_json_from_noise", ("events",), "SELECT event_id, props AS found FROM events")
def _(e):
    return e.select("event_id", tx.json_from_noise(F.concat(F.lit("Here: ```json\n"), F.col("props"), F.lit("\n``` done"))).alias("found"))


@query("FUN11_strip_think", ("turns",), "SELECT session_id, turn_index, trim(left(user_input, 20) || right(user_input, 10)) AS said FROM turns")
def _(t):
    said = F.concat(F.left("user_input", F.lit(20)), F.lit("<think>a\nb</think>"), F.right("user_input", F.lit(10)), F.lit("<think>cut off"))
    return t.select("session_id", "turn_index", tx.strip_think(said).alias("said"))


@query("FUN15_expand_query", ("turns",), "SELECT session_id, turn_index, CASE WHEN length(user_input) < length(role || ' what it is about') THEN role || ' what it is about' ELSE user_input END AS expanded FROM turns")
def _(t):
    return t.select("session_id", "turn_index", tx.expand_query(F.col("user_input"), F.lit("what it is about"), F.col("role")).alias("expanded"))


@query("FUN17_title", ("turns",), "SELECT session_id, turn_index, left(user_input, 30) AS title FROM turns")
def _(t):
    return t.select("session_id", "turn_index", tx.title(F.col("user_input"), F.lit("")).alias("title"))


@query("FUN20_token_estimate", ("sources",), "SELECT source_id, greatest(floor(length(text) / 1.5), 10)::BIGINT AS tokens FROM sources")
def _(s):
    return s.select("source_id", tx.token_estimate(F.col("text")).alias("tokens"))
