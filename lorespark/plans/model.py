"""The knowledge store's tables, derived from the driver's tables: as DataFrames, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name to (driver table, select list). The same text serves Spark and the oracle, so that both start from equal rows.
DERIVED: dict[str, str] = {
    "sources": """SELECT doc_id AS source_id, concat('t', CAST(doc_id % 40 AS VARCHAR(20)), ' ', substr(text, 1, 30)) AS title, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS domain_id,
        CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, n_chars AS word_count, lang, text FROM documents""",
    "domains": "SELECT DISTINCT source AS domain_id, upper(source) AS name FROM documents",
    "concepts": "SELECT CAST(n_nationkey AS BIGINT) AS concept_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS domain_id FROM nation",
    "units": """SELECT p_partkey AS unit_id, CAST(p_size AS BIGINT) AS source_id, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 25 END AS concept_id, p_name AS center,
        CASE WHEN p_partkey % 9 = 0 THEN 'extraction_failed' ELSE 'completed' END AS status FROM part""",
    "points": """SELECT l_orderkey * 10 + l_linenumber AS point_id, l_partkey AS unit_id, concat(l_returnflag, '-', l_linestatus, '-', CAST(l_suppkey AS VARCHAR(20))) AS content,
        l_shipdate AS created_at FROM lineitem""",
    "relations": """SELECT l_orderkey * 10 + l_linenumber AS relation_id, l_partkey AS source_point, l_suppkey + (l_orderkey % 20) * 10 AS target_point,
        CASE WHEN l_linenumber % 4 = 0 THEN 'contradicts' ELSE 'related' END AS relation_type, CASE WHEN l_orderkey % 2 = 0 THEN 'directed' ELSE 'bidirectional' END AS direction FROM lineitem""",
    "traces": """SELECT event_id AS trace_id, concat('Question ', CAST(user_id AS VARCHAR(20)), '?') AS question, concat('terms ', CAST(user_id % 60 AS VARCHAR(20))) AS question_terms,
        user_id % 90 AS question_hash, event_id % 37 AS point_id, CASE WHEN event_type = 'purchase' THEN 'confident' WHEN event_type IN ('click', 'view') THEN 'partial' ELSE 'gap' END AS quality,
        CASE WHEN value > 50 THEN 'deep' ELSE 'short' END AS path, event_type, ts AS created_at FROM events""",
    "turns": "SELECT conv_id AS session_id, turn AS turn_index, role, text AS user_input, CASE WHEN (conv_id + turn) % 3 = 0 THEN NULL ELSE conv_id * 100 + turn END AS answer_id FROM conversations",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a derived one."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    base = text.rsplit(" FROM ", 1)[1].split()[0]
    return spark.sql(text.replace(f" FROM {base}", " FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n]})" for n in names) + " "


def rounded(col, digits: int = 6):
    return F.round(col, digits)
