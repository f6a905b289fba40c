"""What answers leave behind: graded traces, counted points, learning events, and their use by the study cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import study


def traces(answers: DataFrame) -> DataFrame:
    """A trace for each answer (answer_id, question, subject, path, citations, evidence: array of fact_id, point_id, role; null evidence: none).

    confident if a direct fact is cited, else partial if there is any supporting one, else gap. The
    hash is of question and subject, the group of paraphrases the subject or else the question's terms.
    """
    cited = lambda role: F.array_distinct(F.transform(F.filter(F.transform(F.coalesce("citations", F.array().cast("array<string>")), lambda c: F.get(F.filter(F.coalesce("evidence", F.array().cast("array<struct<fact_id:string,point_id:bigint,role:string>>")), lambda e: (e["fact_id"] == c) & (e["role"] == role)), F.lit(0))), lambda e: e.isNotNull() & e["point_id"].isNotNull()), lambda e: e["point_id"]))
    rows = answers.withColumn("direct", cited("direct")).withColumn("supporting", cited("supporting"))
    grade = study.grade(F.col("direct"), F.col("direct"), F.filter("evidence", lambda e: e["role"] == "supporting"))
    subject = F.coalesce("subject", F.lit(""))
    group = F.when(subject != "", subject).otherwise(tx.question_terms(tx.normalise_question(F.col("question"))))
    points = F.when(F.col("quality") == "confident", F.col("direct")).when(F.col("quality") == "partial", F.col("supporting")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("quality", grade)
    return rows.select("answer_id", "question", tx.question_hash(F.col("question"), subject).alias("question_hash"), group.alias("question_terms"), "quality", "path", "direct", points.alias("points"), "created_at")


def cooccurrence(processed: DataFrame) -> DataFrame:
    """Hits of (terms, point), each question's once."""
    rows = processed.select("question_hash", "question_terms", "quality", "created_at", F.col("answer_id").alias("trace_id"), F.explode("points").alias("point_id"))
    return study.cooccurrence(rows)


def learning_events(processed: DataFrame) -> DataFrame:
    """A ``knowledge_gap`` for each trace that found nothing."""
    return processed.filter("quality = 'gap'").select(F.col("answer_id").alias("trace_id"), F.lit("knowledge_gap").alias("event_type"), F.to_json(F.struct("question")).alias("payload"))


def gap_counts(gaps: DataFrame, events: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """Gaps (question_terms, hit_count, question) after more events (event_id, trace_id, payload), with whether one has just reached ``threshold``.

    Events of traces (trace_id, question_terms) that are unknown wait; those without terms count for nothing. The latest event words the question.
    """
    rows = events.join(known.select("trace_id", "question_terms"), "trace_id").filter("question_terms <> ''")
    fresh = rows.groupBy("question_terms").agg(F.count("*").alias("more"), F.max_by(F.get_json_object("payload", "$.question"), "event_id").alias("latest"))
    both = gaps.join(fresh, "question_terms", "full")
    before, more = F.coalesce("hit_count", F.lit(0)), F.coalesce("more", F.lit(0))
    return both.select("question_terms", (before + more).alias("hit_count"), F.coalesce("latest", "question").alias("question"), ((before < threshold) & (before + more >= threshold)).alias("crossed"))
