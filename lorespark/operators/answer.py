"""Answers: the path to take, evidence with its sources and conflicts, feedback as events."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.provider import FAILED, NO_EVIDENCE


def stream(question: str, evidence: list[dict], provider: Callable[[str], Iterator[str]]) -> Iterator[tuple[str, str]]:
    """(phase, text) pairs of an answer as it is made: started, chunks, then done with the whole text, or failed."""
    yield "started", ""
    if not evidence:
        yield "done", NO_EVIDENCE
        return
    parts: list[str] = []
    try:
        for chunk in provider(json.dumps({"question": question, "evidence": evidence}, ensure_ascii=False)):
            parts.append(chunk)
            yield "chunk", chunk
    except Exception:  # whatever a provider raises ends the answer
        yield "failed", FAILED
        return
    yield "done", "".join(parts)


def delivered(events: Iterator[tuple[str, str]]) -> Iterator[str]:
    """Events as server-sent ones: line ends escaped, a blank line after each."""
    for phase, text in events:
        data = text.replace("\r", "").replace("\n", "\\n")
        yield f"event: {phase}\ndata: {data}\n\n"


def save(answers: DataFrame, path: str, version: str, model: str) -> None:
    """Appends answers to the table that trace processing streams from."""
    answers.select("*", F.lit(version).alias("prompt_version"), F.lit(model).alias("model")).write.mode("append").parquet(path)


def route(n_evidence: Column, n_direct: Column, complex_question: Column, deep: Column) -> Column:
    """none without evidence; deep if asked for, if the question is complex or if nothing is direct; else short."""
    return F.when(F.coalesce(n_evidence, F.lit(0)) == 0, "none").when(deep | complex_question | (F.coalesce(n_direct, F.lit(0)) == 0), "deep").otherwise("short")


def evidence(points: DataFrame, units: DataFrame, sources: DataFrame, relations: DataFrame) -> DataFrame:
    """Each point with its unit, a JSON reference to its source, and the sorted contents that contradict it.

    Points whose unit or source is missing are left out. Conflicts are gathered per point, over both
    directions of a relation.
    """
    bad = relations.filter("relation_type = 'contradicts'")
    pairs = bad.select(F.col("source_point").alias("point_id"), F.col("target_point").alias("other"))
    pairs = pairs.unionByName(bad.select(F.col("target_point").alias("point_id"), F.col("source_point").alias("other"))).distinct()
    titles = points.select(F.col("point_id").alias("other"), F.col("content").alias("title"))
    found = pairs.join(titles, "other").groupBy("point_id").agg(F.array_join(F.array_sort(F.collect_set("title")), "|").alias("conflicts"))
    known = points.join(units.select("unit_id", "source_id"), "unit_id").join(sources.select("source_id", F.col("title").alias("source_title")), "source_id")
    ref = F.to_json(F.struct("source_id", "unit_id"))
    return known.join(found, "point_id", "left").select("point_id", "content", ref.alias("source_ref"), F.coalesce("conflicts", F.lit("")).alias("conflicts"))


def corrections(feedback: DataFrame) -> DataFrame:
    """One ``user_correction`` event for each negative or correcting feedback."""
    bad = feedback.filter(F.col("feedback").isin("negative", "correction"))
    return bad.select("answer_id", F.lit("user_correction").alias("event_type"), F.to_json(F.struct("answer_id", "feedback")).alias("payload"))
