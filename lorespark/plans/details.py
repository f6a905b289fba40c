"""Queries of single steps of the pipelines: lookups, updates, groupings, rankings, evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import answer, store, tree
from lorespark.operators import docs as dc
from lorespark.operators import study as st
from lorespark.plans import relational as rel
from lorespark.plans.knowledge import CAND, COOC, MARKDOWN, _cand, _parts

_OWN: list[str] = []


def query(name: str, names: tuple[str, ...], sql: str | None):
    _OWN.append(name)
    return rel.query(name, names, sql)


# --- sources and changes -----------------------------------------------------------------------


@query("SRC03_format_tests", ("sources",), """SELECT source_id, f = 'markdown' AS is_markdown, f IN ('pdf', 'image') AS is_pdf_or_image FROM (SELECT source_id, CASE source_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' ELSE 'other' END AS f FROM sources)""")
def _(s):
    ext = F.element_at(F.array(*map(F.lit, (".MD", ".ofd", ".jpeg", ".bin"))), (F.pmod("source_id", F.lit(4)) + 1).cast("int"))
    f = tx.file_format(F.concat(F.lit("a"), ext))
    return s.select("source_id", (f == "markdown").alias("is_markdown"), f.isin("pdf", "image").alias("is_pdf_or_image"))


@query("SRC07_preset_concepts", ("concepts",), "SELECT concept_id, name FROM concepts UNION ALL SELECT 900, 'PRESET'")
def _(c):
    spark = c.sparkSession
    raw = spark.createDataFrame([('{"concepts": [{"concept_id": 900, "name": "PRESET"}, {"concept_id": 3, "name": "KEPT AS IT WAS"}]}',), ("not json",)], "j string")
    rows = raw.select(F.explode(F.from_json("j", "concepts array<struct<concept_id: bigint, name: string>>")["concepts"]).alias("c")).select("c.*")
    return store.insert_missing(c.select("concept_id", "name"), rows, ["concept_id"])


@query("SNK01_natural_keys", ("points",), "SELECT point_id, sha256(CAST(unit_id AS VARCHAR) || chr(31) || content) AS id FROM points")
def _(p):
    return p.select("point_id", store.natural_key(F.col("unit_id"), F.col("content")).alias("id"))


@query("SNK05_cooccurrence_upsert", ("traces",), f"WITH {COOC} SELECT * FROM cooc")
def _(t):
    day = F.lit("2024-01-15").cast("timestamp")
    return st.cooccurrence_merge(t.filter(F.col("created_at") < day), t.filter(F.col("created_at") >= day))


@query("SNK09_update_columns", ("units",), "SELECT unit_id, coalesce(CASE WHEN status = 'extraction_failed' THEN 99 END, concept_id) AS concept_id, CASE WHEN status = 'extraction_failed' THEN 'pending' ELSE status END AS status FROM units")
def _(u):
    changes = u.filter("status = 'extraction_failed'").select("unit_id", F.lit(99).cast("bigint").alias("concept_id"), F.lit("pending").alias("status"))
    return store.update_columns(u.select("unit_id", "concept_id", "status"), changes, "unit_id")


@query("SNK14_delete_outlines", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_start FROM ol WHERE source_id NOT IN (SELECT source_id FROM sources WHERE status = 'failed')")
def _(s):
    return _parts(s)[2].join(s.filter("status = 'failed'").select("source_id"), "source_id", "left_anti").select("source_id", "line_start")


# --- filters -----------------------------------------------------------------------------------


@query("FLT06_list_cooccurrence", ("traces",), f"WITH {COOC} SELECT question_terms, point_id, confident_count FROM cooc WHERE confident_count >= 2 ORDER BY confident_count DESC, question_terms, point_id LIMIT 50")
def _(t):
    rows = st.cooccurrence(t).filter("confident_count >= 2")
    return store.listing(rows, {}, [F.desc("confident_count"), F.col("question_terms"), F.col("point_id")], 50).select("question_terms", "point_id", "confident_count")


@query("FLT07_list_events", ("traces",), "SELECT trace_id, event_type FROM traces WHERE event_type = 'click' ORDER BY created_at DESC, trace_id LIMIT 50")
def _(t):
    return store.listing(t, {"event_type": "click", "quality": None}, [F.desc("created_at"), F.col("trace_id")], 50).select("trace_id", "event_type")


@query("FLT08_frequent_gaps", ("traces",), "SELECT question_terms, count(*) AS hit_count FROM traces WHERE quality = 'gap' AND question_terms <> '' GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    return store.listing(st.gaps(t).filter("hit_count >= 3"), {}, [F.desc("hit_count"), F.col("question_terms")], 50).select("question_terms", "hit_count")


@query("FLT11_lookups", ("traces", "units"), "SELECT trace_id, point_id, center FROM traces LEFT JOIN units ON unit_id = point_id")
def _(t, u):
    return t.join(u.select(F.col("unit_id").alias("point_id"), "center"), "point_id", "left").select("trace_id", "point_id", "center")


@query("FLT15_roots", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_start, title FROM ol WHERE parent_line IS NULL")
def _(s):
    return tree.roots(_parts(s)[2]).select("source_id", "line_start", "title")


@query("FLT17_valid_units", ("units", "points"), "SELECT unit_id, count(*) AS n_points FROM units JOIN points USING (unit_id) WHERE trim(coalesce(center, '')) <> '' GROUP BY 1 HAVING bool_and(trim(coalesce(content, '')) <> '')")
def _(u, p):
    return store.valid_units(u, p).select("unit_id", "n_points")


@query("FLT23_long_leaves", ("sources",), f"""WITH {MARKDOWN} SELECT a.source_id, a.line_start FROM ol a JOIN sources s USING (source_id)
    WHERE NOT EXISTS (SELECT 1 FROM ol b WHERE b.source_id = a.source_id AND b.parent_line = a.line_start) AND length(array_to_string(list_slice(string_split(s.text, chr(10)), a.line_start, a.line_end), chr(10))) > 200""")
def _(s):
    nodes = _parts(s)[2]
    inner = nodes.filter("parent_line IS NOT NULL").select("source_id", F.col("parent_line").alias("line_start")).distinct()
    leaf = nodes.join(inner, ["source_id", "line_start"], "left_anti").join(s.select("source_id", "text"), "source_id")
    body = tx.line_range(F.col("text"), F.col("line_start").cast("int"), F.col("line_end").cast("int"))
    return leaf.filter(F.char_length(body) > 200).select("source_id", "line_start")


@query("FLT24_strong_candidates", ("traces",), f"""WITH {COOC}, {CAND}, b AS (SELECT point_id, count(DISTINCT question_terms) AS breadth FROM cooc WHERE confident_count > 0 GROUP BY 1),
    sr AS (SELECT point_id, round(avg((path = 'short')::INT), 6) AS short_rate FROM traces WHERE quality = 'confident' GROUP BY 1)
    SELECT question_terms, point_id FROM cand LEFT JOIN b USING (point_id) LEFT JOIN sr USING (point_id) WHERE round(confident_count / hit_count, 6) >= 0.7 AND breadth >= 3 AND short_rate >= 0.6 ORDER BY 1, 2 LIMIT 20""")
def _(t):
    rows = st.recommend(_cand(t), st.cooccurrence(t), t).filter("recommendation = 'strong'")
    return store.listing(rows, {}, [F.col("question_terms"), F.col("point_id")], 20).select("question_terms", "point_id")


@query("FLT25_refused_clarification", ("turns",), "SELECT session_id, coalesce(arg_max(length(user_input) % 2 = 0, turn_index), FALSE) AS skip FROM turns GROUP BY 1")
def _(t):
    log = F.array_sort(F.collect_list(F.struct("turn_index", F.when(F.char_length("user_input") % 2 == 0, "refused").otherwise("answered").alias("response"))))
    return t.groupBy("session_id").agg(F.coalesce(F.element_at(log, -1)["response"] == "refused", F.lit(False)).alias("skip"))


@query("PRJ04_report_sizes", ("traces",), "SELECT question_terms, count(DISTINCT point_id) AS n FROM traces GROUP BY 1")
def _(t):
    stored = t.groupBy("question_terms").agg(F.to_json(F.struct(F.array_sort(F.collect_set("point_id")).alias("points"))).alias("content"))
    return stored.select("question_terms", F.size(F.from_json("content", "points array<bigint>")["points"]).cast("bigint").alias("n"))


# --- joins -------------------------------------------------------------------------------------


@query("JOI04_candidates_by_concept", ("traces", "units"), f"WITH {COOC}, {CAND} SELECT concept_id, string_agg(point_id || ':' || question_terms, '|' ORDER BY point_id, question_terms) AS members FROM cand JOIN units ON unit_id = point_id WHERE concept_id IS NOT NULL GROUP BY 1")
def _(t, u):
    rows = _cand(t).join(u.select(F.col("unit_id").alias("point_id"), "concept_id"), "point_id").filter("concept_id IS NOT NULL")
    members = F.array_sort(F.collect_list(F.struct("point_id", "question_terms")))
    text = F.transform(members, lambda m: F.concat(m["point_id"].cast("string"), F.lit(":"), m["question_terms"]))
    return rows.groupBy("concept_id").agg(F.array_join(text, "|").alias("members"))


@query("JOI08_all_but_newest", ("traces",), "SELECT trace_id FROM traces WHERE trace_id NOT IN (SELECT trace_id FROM traces ORDER BY created_at DESC, trace_id DESC LIMIT 10)")
def _(t):
    newest = store.keep_newest(t.select("trace_id", "created_at"), 10, [F.desc("created_at"), F.desc("trace_id")])
    return t.join(newest, "trace_id", "left_anti").select("trace_id")


@query("JOI10_node_text", ("sources",), f"WITH {MARKDOWN} SELECT a.source_id, a.line_start, sha256(array_to_string(list_slice(string_split(s.text, chr(10)), a.line_start, a.line_end), chr(10))) AS body FROM ol a JOIN sources s USING (source_id)")
def _(s):
    body = tx.line_range(F.col("text"), F.col("line_start").cast("int"), F.col("line_end").cast("int"))
    return _parts(s)[2].join(s.select("source_id", "text"), "source_id").select("source_id", "line_start", F.sha2(body, 256).alias("body"))


@query("JOI11_hits_by_source", ("sources", "domains"), "SELECT d.domain_id, d.name, count(s.source_id) AS n, min(s.source_id) AS first_id FROM domains d LEFT JOIN sources s USING (domain_id) GROUP BY ALL")
def _(s, d):
    hits = s.groupBy("domain_id").agg(F.count("*").alias("n"), F.min("source_id").alias("first_id"))
    return d.join(hits, "domain_id", "left").select("domain_id", "name", F.coalesce("n", F.lit(0)).alias("n"), "first_id")


@query("JOI13_point_to_unit", ("points", "units"), "SELECT point_id, unit_id, center FROM points JOIN units USING (unit_id) WHERE status = 'completed'")
def _(p, u):
    return p.join(u.filter("status = 'completed'"), "unit_id").select("point_id", "unit_id", "center")


@query("JOI16_concepts_of_domain", ("concepts",), "SELECT 'all' AS asked, concept_id FROM concepts UNION ALL SELECT 'one', concept_id FROM concepts WHERE domain_id = 2")
def _(c):
    return store.listing(c, {"domain_id": None}, [F.col("concept_id")]).select(F.lit("all").alias("asked"), "concept_id").unionByName(store.listing(c, {"domain_id": 2}, [F.col("concept_id")]).select(F.lit("one").alias("asked"), "concept_id"))


# --- aggregates --------------------------------------------------------------------------------


@query("AGG02_count_filtered", ("sources",), "SELECT count(*) AS n FROM sources WHERE status = 'completed' AND lang = 'en'")
def _(s):
    return s.filter("status = 'completed' AND lang = 'en'").agg(F.count("*").alias("n"))


@query("AGG08_purity", ("traces",), f"WITH {COOC} SELECT question_terms, point_id, round(CASE WHEN hit_count = 0 THEN 0 ELSE confident_count / hit_count END, 6) AS purity FROM cooc")
def _(t):
    return st.cooccurrence(t).select("question_terms", "point_id", F.round(st.purity(F.col("confident_count"), F.col("hit_count")), 6).alias("purity"))


@query("AGG16_outline_sums", ("sources",), f"WITH {MARKDOWN} SELECT source_id, count(*) AS n, sum(line_end - line_start + 1)::BIGINT AS covered, min(level) = max(level) AS flat FROM ol GROUP BY 1")
def _(s):
    return _parts(s)[2].groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("covered"), (F.min("level") == F.max("level")).alias("flat"))


@query("AGG19_joined_titles", ("sources",), f"WITH {MARKDOWN} SELECT source_id, array_to_string(list_slice(list(title ORDER BY line_start), 1, 5), '; ') AS titles FROM ol WHERE level = 1 GROUP BY 1")
def _(s):
    titles = F.transform(F.array_sort(F.collect_list(F.struct("line_start", "title"))), lambda x: x["title"])
    return _parts(s)[2].filter("level = 1").groupBy("source_id").agg(F.array_join(F.slice(titles, 1, 5), "; ").alias("titles"))


@query("AGG21_gap_entries", ("traces",), "SELECT question_terms, count(*) AS hit_count, 'add_source' AS recommendation FROM traces WHERE quality = 'gap' AND question_terms <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return st.gaps(t).orderBy(F.desc("hit_count"), "question_terms").limit(10).select("question_terms", "hit_count", F.lit("add_source").alias("recommendation"))


# --- windows, order, sets ------------------------------------------------------------------------


@query("WIN02_heading_ends", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_start, line_end FROM ol")
def _(s):
    return _parts(s)[2].select("source_id", "line_start", "line_end")


@query("WIN03_parents", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_start, parent_line FROM ol")
def _(s):
    return _parts(s)[2].select("source_id", "line_start", "parent_line")


@query("WIN04_positions", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_start, position FROM ol")
def _(s):
    return _parts(s)[2].select("source_id", "line_start", "position")


@query("SRT05_page", ("sources",), "SELECT source_id, status FROM sources ORDER BY source_id LIMIT 20 OFFSET 40")
def _(s):
    return store.listing(s, {}, [F.col("source_id")], 20, 40).select("source_id", "status")


@query("SRT09_sorted_tokens", ("sources",), r"SELECT source_id, sha256(array_to_string(list_sort(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')), ' ')) AS sorted FROM sources")
def _(s):
    return s.select("source_id", F.sha2(F.array_join(F.array_sort(tx.tokens(F.col("text"))), " "), 256).alias("sorted"))


@query("SET01_union_of_edges", ("relations",), "SELECT source_point AS point_id, target_point AS other FROM relations UNION SELECT target_point, source_point FROM relations WHERE direction = 'bidirectional'")
def _(r):
    back = r.filter("direction = 'bidirectional'").select(F.col("target_point").alias("point_id"), F.col("source_point").alias("other"))
    return r.select(F.col("source_point").alias("point_id"), F.col("target_point").alias("other")).union(back).distinct()


@query("SET04_first_sights", ("traces",), "SELECT question_hash, point_id, min((created_at, trace_id))[2] AS trace_id FROM traces GROUP BY ALL")
def _(t):
    return t.groupBy("question_hash", "point_id").agg(F.min_by("trace_id", F.struct("created_at", "trace_id")).alias("trace_id"))


# --- scalars -------------------------------------------------------------------------------------


@query("FUN14_truncate", ("sources",), "SELECT source_id, coalesce(nullif(substr(trim(title), 1, 12), ''), 'untitled') AS title FROM sources")
def _(s):
    return s.select("source_id", F.coalesce(F.nullif(F.left(F.trim("title"), F.lit(12)), F.lit("")), F.lit("untitled")).alias("title"))


@query("FUN18_json_round_trip", ("turns",), "SELECT session_id, turn_index, user_input FROM turns")
def _(t):
    stored = F.to_json(F.struct("user_input"))
    return t.select("session_id", "turn_index", F.from_json(stored, "user_input string")["user_input"].alias("user_input"))


@query("FUN21_lengths", ("sources",), "SELECT source_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM sources")
def _(s):
    return s.select("source_id", F.char_length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n")).cast("bigint").alias("lines"))


@query("FUN22_lines_in_budget", ("sources",), f"WITH {MARKDOWN} SELECT source_id, count(*) AS n FROM (SELECT source_id, sum(length(line) + 1) OVER (PARTITION BY source_id ORDER BY line_no) AS used FROM md) WHERE used <= 500 GROUP BY 1")
def _(s):
    used = F.sum(F.char_length("line") + 1).over(W.partitionBy("source_id").orderBy("line_no"))
    return _parts(s)[0].withColumn("used", used).filter("used <= 500").groupBy("source_id").agg(F.count("*").alias("n"))


# --- retrieval and answers -----------------------------------------------------------------------


@query("TRC03_corrections", ("turns",), """SELECT answer_id, 'user_correction' AS event_type, '{"answer_id":' || answer_id || ',"feedback":"' || f || '"}' AS payload FROM (SELECT answer_id, CASE length(coalesce(user_input, '')) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'correction' ELSE 'positive' END AS f FROM turns WHERE answer_id IS NOT NULL) WHERE f <> 'positive'""")
def _(t):
    kind = F.element_at(F.array(F.lit("negative"), F.lit("correction"), F.lit("positive")), F.char_length(F.coalesce("user_input", F.lit(""))) % 3 + 1)
    return answer.corrections(t.filter("answer_id IS NOT NULL").select("answer_id", kind.alias("feedback")))


@query("DOC05_rule_merge", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_no AS line_start, coalesce(lead(line_no) OVER (PARTITION BY source_id ORDER BY line_no) - 1, total_lines) AS line_end FROM hd JOIN tot USING (source_id)")
def _(s):
    md, totals, _ = _parts(s)
    flat = dc.headings(md).withColumn("level", F.lit(1).cast("bigint"))
    return dc.outline(flat, totals).select("source_id", "line_start", "line_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: rel.QUERIES.pop(n) for n in _OWN}
SQL: dict[str, str] = {n: rel.SQL.pop(n) for n in _OWN if n in rel.SQL}
