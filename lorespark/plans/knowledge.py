"""Queries of the pipelines: usage analytics, document ETL, retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import docs as dc
from lorespark.operators import study as st
from lorespark.plans import relational as rel

_OWN: list[str] = []


def query(name: str, names: tuple[str, ...], sql: str | None):
    _OWN.append(name)
    return rel.query(name, names, sql)


# --- usage analytics -------------------------------------------------------------------------

COOC = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_hash, point_id ORDER BY created_at, trace_id) AS r FROM traces) WHERE r = 1),
    cooc AS (SELECT question_terms, point_id, count(*)::BIGINT AS hit_count, count_if(quality = 'confident')::BIGINT AS confident_count, max(created_at) AS last_seen_at FROM f GROUP BY ALL)"""
CAND = "cand AS (SELECT * FROM cooc WHERE confident_count >= 1 AND confident_count / hit_count >= 0.3 ORDER BY confident_count DESC, question_terms, point_id LIMIT 200)"


def _cand(t: DataFrame) -> DataFrame:
    return st.candidates(st.cooccurrence(t), 1, 0.3, 200)


@query("AGG06_cooccurrence", ("traces",), f"WITH {COOC} SELECT * FROM cooc")
def _(t):
    return st.cooccurrence(t)


@query("FLT09_candidates", ("traces",), f"WITH {COOC}, {CAND} SELECT question_terms, point_id, hit_count, confident_count FROM cand")
def _(t):
    return _cand(t).drop("last_seen_at")


@query("AGG01_trace_summary", ("traces",), """SELECT count(*)::BIGINT AS total, count_if(quality = 'confident')::BIGINT AS confident, count_if(quality = 'partial')::BIGINT AS partial, count_if(quality = 'gap')::BIGINT AS gap,
    round(coalesce(count_if(quality = 'confident') / nullif(count(*), 0), 0), 6) AS confident_rate FROM traces WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 5 DAY""")
def _(t):
    return st.trace_summary(t, "2024-01-20 00:00:00", 5)


@query("AGG03_breadth", ("traces",), f"WITH {COOC} SELECT point_id, count(DISTINCT question_terms)::BIGINT AS breadth FROM cooc WHERE confident_count > 0 GROUP BY 1")
def _(t):
    return st.breadth(st.cooccurrence(t))


@query("AGG04_active_days", ("traces",), f"WITH {COOC} SELECT point_id, count(DISTINCT CAST(last_seen_at AS DATE))::BIGINT AS days FROM cooc GROUP BY 1")
def _(t):
    return st.cooccurrence(t).groupBy("point_id").agg(F.count_distinct(F.to_date("last_seen_at")).alias("days"))


@query("AGG05_last_seen", ("traces", "units"), f"WITH {COOC} SELECT unit_id, max(last_seen_at) AS last_seen_at FROM units LEFT JOIN cooc ON point_id = unit_id GROUP BY 1")
def _(t, u):
    last = st.cooccurrence(t).groupBy("point_id").agg(F.max("last_seen_at").alias("last_seen_at"))
    return u.join(last, u["unit_id"] == last["point_id"], "left").select("unit_id", "last_seen_at")


@query("AGG07_short_rate", ("traces",), "SELECT point_id, round(avg(CASE WHEN path = 'short' THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_rate FROM traces WHERE quality = 'confident' GROUP BY 1")
def _(t):
    return st.short_rate(t)


@query("AGG09_internal_edges", ("units", "relations"), """SELECT a.concept_id, count(*)::BIGINT AS edges FROM relations r JOIN units a ON r.source_point = a.unit_id JOIN units b ON r.target_point = b.unit_id
    WHERE a.concept_id = b.concept_id GROUP BY 1""")
def _(u, r):
    return st.internal_edges(r, u.filter("concept_id IS NOT NULL").select("concept_id", F.col("unit_id").alias("point_id")))


@query("AGG10_concept_rollup", ("traces", "units", "relations"), f"""WITH {COOC}, {CAND}, m AS (SELECT concept_id, point_id, confident_count FROM cand JOIN units ON point_id = unit_id WHERE concept_id IS NOT NULL),
    s AS (SELECT concept_id, count(DISTINCT point_id)::BIGINT AS points, round(avg(confident_count), 6) AS mean_confident FROM m GROUP BY 1), d AS (SELECT DISTINCT concept_id, point_id FROM m),
    e AS (SELECT a.concept_id, count(*)::BIGINT AS edges FROM relations JOIN d a ON source_point = a.point_id JOIN d b ON target_point = b.point_id WHERE a.concept_id = b.concept_id GROUP BY 1)
    SELECT concept_id, points, mean_confident, coalesce(edges, 0) AS edges, points >= 2 AND coalesce(edges, 0) >= 1 AS ready FROM s LEFT JOIN e USING (concept_id)""")
def _(t, u, r):
    return st.concept_rollup(_cand(t), u, r, 2, 1)


@query("AGG11_recommend", ("traces",), f"""WITH {COOC}, {CAND}, b AS (SELECT point_id, count(DISTINCT question_terms)::BIGINT AS breadth FROM cooc WHERE confident_count > 0 GROUP BY 1),
    p AS (SELECT point_id, round(avg(CASE WHEN path = 'short' THEN 1.0::DOUBLE ELSE 0 END), 6) AS short_rate FROM traces WHERE quality = 'confident' GROUP BY 1),
    x AS (SELECT question_terms, point_id, hit_count, round(confident_count / hit_count, 6) AS purity, coalesce(breadth, 0) AS breadth, coalesce(short_rate, 0) AS short_rate FROM cand LEFT JOIN b USING (point_id) LEFT JOIN p USING (point_id))
    SELECT question_terms, point_id, purity, breadth, short_rate, CASE WHEN purity >= 0.7 AND breadth >= 3 AND short_rate >= 0.6 THEN 'strong' ELSE 'candidate' END AS recommendation,
    'breadth ' || breadth || ', hits ' || hit_count AS reason FROM x""")
def _(t):
    return st.recommend(_cand(t), st.cooccurrence(t), t)


@query("AGG18_first_point", ("points",), "SELECT unit_id, arg_min(point_id, (created_at, point_id)) AS point_id FROM points GROUP BY 1")
def _(p):
    return p.groupBy("unit_id").agg(F.min_by("point_id", F.struct("created_at", "point_id")).alias("point_id"))


@query("AGG17_index_health", ("units", "points"), "SELECT count(*)::BIGINT AS n, count_if(status = 'completed')::BIGINT AS indexed, round(count_if(status = 'completed') / count(*), 6) AS ratio, count_if(status = 'completed') / count(*) BETWEEN 0.9 AND 1.1 AS healthy FROM units")
def _(u, p):
    out = u.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("indexed"))
    ratio = F.try_divide("indexed", "n")
    return out.select("n", "indexed", F.round(ratio, 6).alias("ratio"), ratio.between(0.9, 1.1).alias("healthy"))


# --- document ETL: a Markdown view of the documents, made by a rule on line numbers -----------

MARKDOWN = """md AS (SELECT source_id, i::BIGINT AS line_no, CASE WHEN i = 1 THEN '# ' WHEN i % 13 = 5 THEN '```' WHEN i % 10 = 0 THEN '## ' WHEN i % 4 = 0 THEN '##### ' ELSE '' END || l[i] AS line
    FROM (SELECT source_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source_id, string_split(text, chr(10)) AS l FROM sources))),
    fn AS (SELECT *, starts_with(ltrim(line), '```') AS is_fence, sum(starts_with(ltrim(line), '```')::INT) OVER (PARTITION BY source_id ORDER BY line_no) AS fences FROM md),
    tot AS (SELECT source_id, max(line_no) AS total_lines FROM md GROUP BY 1),
    hd AS (SELECT source_id, line_no, least(length(regexp_extract(line, '^(#+)', 1)), 4)::BIGINT AS level, trim(regexp_replace(line, '^#+', '')) AS title FROM fn
        WHERE NOT is_fence AND fences % 2 = 0 AND regexp_matches(line, '^#{1,6}\\s+\\S')),
    ol AS (SELECT *, row_number() OVER (PARTITION BY source_id, parent_line ORDER BY line_start) - 1 AS position FROM (
        SELECT a.source_id, a.line_no AS line_start, coalesce(lead(a.line_no) OVER (PARTITION BY a.source_id ORDER BY a.line_no) - 1, total_lines) AS line_end, a.level, a.title,
            (SELECT max(b.line_no) FROM hd b WHERE b.source_id = a.source_id AND b.line_no < a.line_no AND b.level < a.level) AS parent_line FROM hd a JOIN tot USING (source_id)))""".replace("\\\\", "\\")


def _mark(n):
    """What the view puts before line ``n``."""
    return F.when(n == 1, "# ").when(n % 13 == 5, "```").when(n % 10 == 0, "## ").when(n % 4 == 0, "##### ").otherwise("")


def _markdown(s: DataFrame) -> DataFrame:
    return dc.lines(s).withColumn("line", F.concat(_mark(F.col("line_no")), "line"))


def _parts(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    md = _markdown(s)
    totals = md.groupBy("source_id").agg(F.max("line_no").alias("total_lines"))
    return md, totals, dc.outline(dc.headings(md), totals)


@query("WIN05_fences", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_no, is_fence, NOT is_fence AND fences % 2 = 1 AS in_code FROM fn")
def _(s):
    return dc.fenced(_markdown(s)).select("source_id", "line_no", "is_fence", "in_code")


@query("WIN06_break_priorities", ("sources",), rf"""WITH {MARKDOWN} SELECT source_id, line_no, CASE WHEN is_fence OR fences % 2 = 1 OR starts_with(trim(line), '|') THEN 0 WHEN regexp_matches(line, '^#{{1,6}}\s+\S') THEN 3 WHEN trim(line) = '' THEN 2 ELSE 1 END AS priority FROM fn""")
def _(s):
    return dc.break_priorities(_markdown(s))


@query("DOC01_outline", ("sources",), f"WITH {MARKDOWN} SELECT * FROM ol")
def _(s):
    return _parts(s)[2].drop("parent_level")


@query("WIN07_virtual_headings", ("sources",), f"""WITH {MARKDOWN} SELECT source_id, line_no, unnest(range(prev + 1, level)) AS level FROM (SELECT *, lag(level) OVER (PARTITION BY source_id ORDER BY line_no) AS prev FROM hd) WHERE level > prev + 1""")
def _(s):
    return dc.virtual_headings(dc.headings(_markdown(s)))


@query("FLT22_triggers", ("sources",), f"""WITH {MARKDOWN}, n AS (SELECT source_id, count(*) AS n, sum(line_end - line_start + 1) AS covered, min(level) = max(level) AS flat FROM ol GROUP BY 1),
    lf AS (SELECT a.source_id, max((SELECT length(array_to_string(list_slice(string_split(s.text, chr(10)), a.line_start, a.line_end), chr(10))))) AS longest FROM ol a JOIN sources s USING (source_id)
        WHERE NOT EXISTS (SELECT 1 FROM ol b WHERE b.source_id = a.source_id AND b.parent_line = a.line_start) GROUP BY 1)
    SELECT source_id, CASE WHEN n IS NULL THEN 'A' ELSE '' END || CASE WHEN n < 3 AND length(text) > 2000 THEN 'B' ELSE '' END || CASE WHEN covered / len(string_split(text, chr(10))) < 0.5 THEN 'C' ELSE '' END
        || CASE WHEN n < 5 AND flat THEN 'D' ELSE '' END || CASE WHEN longest > 1500 THEN 'E' ELSE '' END AS reasons FROM sources LEFT JOIN n USING (source_id) LEFT JOIN lf USING (source_id)""")
def _(s):
    return dc.triggers(_parts(s)[2], s, 1500)


@query("WIN08_repair_sections", ("sources",), f"""WITH {MARKDOWN}, c AS (SELECT source_id, title, line_start, least(line_end + 3, total_lines) AS line_end, least(level, 3) AS level, total_lines FROM ol JOIN tot USING (source_id) WHERE trim(title) <> ''),
    x AS (SELECT *, lead(level) OVER w AS nl, lead(line_start) OVER w AS ns, min(level) OVER (PARTITION BY source_id) AS top, row_number() OVER (PARTITION BY source_id ORDER BY level, line_start DESC, title DESC) AS last FROM c WINDOW w AS (PARTITION BY source_id ORDER BY line_start, level, title))
    SELECT source_id, title, line_start, CASE WHEN level = top AND last = 1 THEN total_lines WHEN nl = level THEN greatest(ns - 1, line_start) ELSE line_end END AS line_end, level FROM x""")
def _(s):
    _, totals, nodes = _parts(s)
    return dc.repair_sections(nodes.withColumn("line_end", F.col("line_end") + 3), totals)


@query("JOI09_deepest_container", ("sources",), f"""WITH {MARKDOWN}, sg AS (SELECT source_id, line_no AS line_start, least(line_no + 1, total_lines) AS line_end FROM md JOIN tot USING (source_id) WHERE line_no % 3 = 1)
    SELECT sg.source_id, sg.line_start, sg.line_end, arg_max(ol.line_start, (ol.level, -ol.line_start)) AS container FROM sg LEFT JOIN ol ON ol.source_id = sg.source_id AND ol.line_start <= sg.line_start AND ol.line_end >= sg.line_end GROUP BY ALL""")
def _(s):
    from lorespark.operators.store import deepest_container

    md, totals, nodes = _parts(s)
    seg = md.join(totals, "source_id").filter("line_no % 3 = 1").select("source_id", F.col("line_no").alias("line_start"), F.least(F.col("line_no") + 1, F.col("total_lines")).alias("line_end"))
    return deepest_container(seg, nodes.withColumn("outline_id", F.col("line_start")))


@query("FUN06_clean_markdown", ("pages",), r"SELECT page_id, regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '<!--.*?-->', '', 'gs') AS text FROM pages")
def _(p):
    return p.select("page_id", dc.clean_markdown(F.col("html")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: rel.QUERIES.pop(n) for n in _OWN}
SQL: dict[str, str] = {n: rel.SQL.pop(n) for n in _OWN if n in rel.SQL}
