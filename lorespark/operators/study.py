"""Usage analytics: grading, co-occurrence counts, candidates, gaps, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grade(cited: Column, direct: Column, supporting: Column) -> Column:
    """confident if a direct point is cited, else partial if there is any supporting one, else gap."""
    hit = F.size(F.array_intersect(F.coalesce(cited, F.array()), F.coalesce(direct, F.array()))) > 0
    return F.when(hit, "confident").when(F.size(F.coalesce(supporting, F.array())) > 0, "partial").otherwise("gap")


def cooccurrence(traces: DataFrame) -> DataFrame:
    """Hits of (terms, point): only the first trace of a (question, point) counts, with its quality at that time."""
    w = W.partitionBy("question_hash", "point_id").orderBy("created_at", "trace_id")
    first = traces.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return first.groupBy("question_terms", "point_id").agg(
        F.count("*").alias("hit_count"), F.count_if(F.col("quality") == "confident").alias("confident_count"), F.max("created_at").alias("last_seen_at")
    )


def purity(confident: Column, hits: Column) -> Column:
    return F.coalesce(F.try_divide(confident, hits), F.lit(0.0))


def candidates(cooc: DataFrame, min_confident: int, min_ratio: float, batch: int) -> DataFrame:
    ok = cooc.filter((F.col("confident_count") >= min_confident) & (F.try_divide("confident_count", "hit_count") >= min_ratio))
    return ok.orderBy(F.desc("confident_count"), "question_terms", "point_id").limit(batch)


def trace_summary(traces: DataFrame, as_of: str, days: int) -> DataFrame:
    """Traces of the last ``days`` by quality, and the share of confident ones, 0 if there are none."""
    recent = traces.filter(F.col("created_at") >= F.expr(f"timestamp '{as_of}' - interval {int(days)} days"))
    out = recent.agg(F.count("*").alias("total"), *(F.count_if(F.col("quality") == q).alias(q) for q in ("confident", "partial", "gap")))
    return out.withColumn("confident_rate", F.round(purity(F.col("confident"), F.col("total")), 6))


def breadth(cooc: DataFrame) -> DataFrame:
    return cooc.filter("confident_count > 0").groupBy("point_id").agg(F.count_distinct("question_terms").alias("breadth"))


def short_rate(traces: DataFrame) -> DataFrame:
    ok = traces.filter("quality = 'confident'")
    return ok.groupBy("point_id").agg(F.round(F.avg((F.col("path") == "short").cast("double")), 6).alias("short_rate"))


def recommend(cand: DataFrame, cooc: DataFrame, traces: DataFrame) -> DataFrame:
    """strong from a purity of 0.7, 3 questions and a short rate of 0.6 on, else candidate; with the reason in words."""
    out = cand.join(breadth(cooc), "point_id", "left").join(short_rate(traces), "point_id", "left").fillna({"breadth": 0, "short_rate": 0.0})
    p = F.round(purity(F.col("confident_count"), F.col("hit_count")), 6)
    strong = (p >= 0.7) & (F.col("breadth") >= 3) & (F.col("short_rate") >= 0.6)
    return out.select(
        "question_terms", "point_id", p.alias("purity"), "breadth", "short_rate",
        F.when(strong, "strong").otherwise("candidate").alias("recommendation"),
        F.concat(F.lit("breadth "), F.col("breadth").cast("string"), F.lit(", hits "), F.col("hit_count").cast("string")).alias("reason"),
    )


def gaps(traces: DataFrame) -> DataFrame:
    """Questions that found nothing, by terms: how often, and the latest wording."""
    bad = traces.filter("quality = 'gap' AND question_terms <> ''")
    return bad.groupBy("question_terms").agg(F.count("*").alias("hit_count"), F.max_by("question", F.struct("created_at", "trace_id")).alias("question"))


def internal_edges(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Relations with both ends in a concept, by concept (``members``: concept_id, point_id)."""
    a = members.select(F.col("concept_id"), F.col("point_id").alias("source_point"))
    b = members.select(F.col("concept_id").alias("_c"), F.col("point_id").alias("target_point"))
    both = relations.join(a, "source_point").join(b, "target_point").filter("concept_id = _c")
    return both.groupBy("concept_id").agg(F.count("*").alias("edges"))


def concept_rollup(cand: DataFrame, units: DataFrame, relations: DataFrame, least_points: int, least_edges: int) -> DataFrame:
    """Per concept: points with candidates, mean confident count, relations inside, and whether it is ready."""
    members = cand.join(units.select("unit_id", "concept_id"), cand["point_id"] == units["unit_id"]).filter("concept_id IS NOT NULL")
    sums = members.groupBy("concept_id").agg(F.count_distinct("point_id").alias("points"), F.round(F.avg("confident_count"), 6).alias("mean_confident"))
    inner = internal_edges(relations, members.select("concept_id", "point_id").distinct())
    out = sums.join(inner, "concept_id", "left").fillna({"edges": 0})
    return out.withColumn("ready", (F.col("points") >= least_points) & (F.col("edges") >= least_edges))


def report(summary: DataFrame, cand: DataFrame, top_gaps: DataFrame) -> DataFrame:
    """One row: the summary and the lists, the gaps as JSON."""
    c = cand.agg(F.count("*").alias("n_candidates"))
    g = top_gaps.agg(F.to_json(F.array_sort(F.collect_list(F.struct("question_terms", "hit_count")))).alias("gaps"))
    return summary.crossJoin(c).crossJoin(g)  # one row each


def report_document(summary: DataFrame, links: DataFrame, top_gaps: DataFrame) -> DataFrame:
    """One row, ``content``: the whole report as JSON. Both lists are top-k reports."""
    rows = links.agg(F.array_sort(F.collect_list(F.struct("question_terms", "point_id", "purity", "breadth", "recommendation", "reason"))).alias("links"))
    g = top_gaps.agg(F.array_sort(F.collect_list(F.struct("question_terms", "hit_count"))).alias("gaps"))
    one = summary.select(F.struct("*").alias("summary")).crossJoin(rows).crossJoin(g)  # one row each
    return one.select(F.to_json(F.struct("summary", "links", "gaps")).alias("content"))


def save_report(document: DataFrame, path: str, keep: int) -> int:
    """Writes a report as the next version, and drops all but the newest ``keep``."""
    from lorespark.sources.shared import delete
    from lorespark.sources.snapshot import versions

    spark = document.sparkSession
    found = versions(spark, path)
    version = (found[-1] if found else 0) + 1
    document.write.parquet(f"{path}/v={version}")
    for old in [*found, version][:-keep]:
        delete(spark, f"{path}/v={old}")
    return version


def reports(spark: SparkSession, path: str) -> DataFrame:
    """``version, content`` of the reports that are kept."""
    return spark.read.parquet(path).select(F.col("v").cast("int").alias("version"), "content")


def cooccurrence_merge(before: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts after a later batch: its first sights of (question, point) that weren't seen before add to the old counts."""
    seen = before.select("question_hash", "point_id").distinct()
    fresh = batch.join(seen, ["question_hash", "point_id"], "left_anti")
    both = cooccurrence(before).unionByName(cooccurrence(fresh))
    return both.groupBy("question_terms", "point_id").agg(F.sum("hit_count").alias("hit_count"), F.sum("confident_count").alias("confident_count"), F.max("last_seen_at").alias("last_seen_at"))
