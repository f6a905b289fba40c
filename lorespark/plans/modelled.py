"""Queries of the steps that a model answers, with deterministic providers in its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import provider as pv
from lorespark.plans import relational as rel
from lorespark.plans.knowledge import MARKDOWN, _parts
from lorespark.plans.retrieving import KB, _outlines, _points, _units

_OWN: list[str] = []


def query(name: str, names: tuple[str, ...], sql: str | None):
    _OWN.append(name)
    return rel.query(name, names, sql)


@query("DOC08_node_summaries", ("sources",), f"WITH {MARKDOWN} SELECT source_id, line_start, trim(regexp_replace(translate(title || ' key', '，,、；;', '     '), ' +', ' ', 'g')) AS summary FROM ol")
def _(s):
    return pv.node_summaries(_parts(s)[2].select("source_id", "line_start", "title"), pv.title_words)


def _relations(s: DataFrame, size: int) -> DataFrame:
    """Neighbours in a request are related; chapters begin at level 2."""
    u = _units(s)
    nodes = _outlines(s).withColumn("parent_id", F.when(F.col("level") > 2, F.col("parent_id")))
    return pv.relations(_points(u), u.withColumn("center", F.left("content", F.lit(40))), nodes, pv.neighbours_related, size)


@query("DOC12_relations", ("sources",), f"""WITH RECURSIVE {KB}, tp AS (SELECT outline_id, outline_id AS root FROM od WHERE level <= 2 UNION ALL SELECT o.outline_id, t.root FROM od o JOIN tp t ON t.outline_id = o.parent_id WHERE o.level > 2),
    pn AS (SELECT p.point_id, u.source_id, t.root, count(*) OVER (PARTITION BY u.source_id) AS n FROM kp p JOIN ku u USING (unit_id) LEFT JOIN tp t USING (outline_id)),
    pb AS (SELECT *, (row_number() OVER (PARTITION BY source_id, grp ORDER BY point_id) - 1) // 60 AS batch FROM (SELECT *, CASE WHEN n <= 60 THEN 'all' ELSE coalesce(root::VARCHAR, 'ungrouped') END AS grp FROM pn))
    SELECT point_id AS source_point, nxt AS target_point, 'related' AS relation_type, 'bidirectional' AS direction FROM (SELECT point_id, lead(point_id) OVER (PARTITION BY source_id, grp, batch ORDER BY point_id) AS nxt FROM pb) WHERE nxt IS NOT NULL""")
def _(s):
    return _relations(s, 60)


@query("DOC12_relations_by_chapter", ("sources",), f"""WITH RECURSIVE {KB}, tp AS (SELECT outline_id, outline_id AS root FROM od WHERE level <= 2 UNION ALL SELECT o.outline_id, t.root FROM od o JOIN tp t ON t.outline_id = o.parent_id WHERE o.level > 2),
    pn AS (SELECT p.point_id, u.source_id, t.root, count(*) OVER (PARTITION BY u.source_id) AS n FROM kp p JOIN ku u USING (unit_id) LEFT JOIN tp t USING (outline_id)),
    pb AS (SELECT *, (row_number() OVER (PARTITION BY source_id, grp ORDER BY point_id) - 1) // 6 AS batch FROM (SELECT *, CASE WHEN n <= 6 THEN 'all' ELSE coalesce(root::VARCHAR, 'ungrouped') END AS grp FROM pn))
    SELECT point_id AS source_point, nxt AS target_point, 'related' AS relation_type, 'bidirectional' AS direction FROM (SELECT point_id, lead(point_id) OVER (PARTITION BY source_id, grp, batch ORDER BY point_id) AS nxt FROM pb) WHERE nxt IS NOT NULL""")
def _(s):
    return _relations(s, 6)


@query("DOC13_match_concepts", ("units", "concepts"), "SELECT unit_id, c.concept_id FROM units JOIN (SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS i, count(*) OVER () AS n FROM concepts) c ON length(center) % n = i")
def _(u, c):
    return pv.match_concepts(u, c, pv.by_length)


@query("ANS02_generate", ("units", "points"), f"""SELECT unit_id AS q, CASE WHEN count(point_id) = 0 THEN '{pv.NO_EVIDENCE}' ELSE count(point_id) || ' findings' END AS content,
    coalesce(string_agg(point_id::VARCHAR, ',' ORDER BY point_id::VARCHAR), '') AS citations FROM units LEFT JOIN points USING (unit_id) GROUP BY 1""")
def _(u, p):
    found = p.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct(F.col("point_id").cast("string").alias("id"), "content"))).alias("evidence"))
    rows = u.join(found, "unit_id", "left").select(F.col("unit_id").alias("q"), F.col("center").alias("question"), "evidence")
    return pv.generate(rows, pv.cite_all).withColumn("citations", F.array_join("citations", ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: rel.QUERIES.pop(n) for n in _OWN}
SQL: dict[str, str] = {n: rel.SQL.pop(n) for n in _OWN if n in rel.SQL}
