"""The document pipeline as one plan: normalise, outline, refine where needed, summarise, segment; and runs of failed ones."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.operators import docs as dc
from lorespark.operators import provider as pv
from lorespark.operators import refine, sketch, tree
from lorespark.sources.shared import stored


@dataclass(frozen=True)
class Processed:
    sources: DataFrame  # source_id, status, word_count, reasons, outline_type
    outlines: DataFrame  # source_id, line_start, line_end, level, title, parent_line, parent_level, position, node_type


def parse_sections(replies: DataFrame, totals: DataFrame) -> DataFrame:
    """Outlines from replies (source_id, reply: JSON): repaired sections with parents and positions; a reply that isn't JSON gives none."""
    schema = "sections array<struct<title: string, line_start: bigint, line_end: bigint, level: bigint>>"
    rows = replies.select("source_id", F.explode(F.from_json("reply", schema)["sections"]).alias("s")).select("source_id", "s.*")
    return placed(dc.repair_sections(rows, totals))


def placed(sections: DataFrame) -> DataFrame:
    """Parent (the latest earlier section of a lower level) and place among siblings of sections that have their lines."""
    before = W.partitionBy("source_id").orderBy("line_start", "level", "title").rowsBetween(W.unboundedPreceding, -1)
    found = [F.last(F.when(F.col("level") == k, F.struct("line_start", "level")), ignorenulls=True).over(before) for k in (1, 2)]
    parent = F.greatest(*(F.when(F.col("level") > k, x) for k, x in zip((1, 2), found)))
    out = sections.withColumn("parent", parent).withColumns({"parent_line": F.col("parent.line_start"), "parent_level": F.col("parent.level"), "node_type": F.lit("semantic")})
    return refine.positioned(out)


def process(sources: DataFrame, provider: pv.Provider, max_chars: int = 1500, usable: int = 2000) -> Processed:
    """Sources (source_id, text; null: conversion failed) with their outline.

    The structural outline stays if nothing asks for more. If only long leaves do, these are refined, and the outline is
    mixed where that gave nodes; for any other reason a model makes a semantic one, and where it gives
    nothing, the structural one stays. Semantic outlines of texts over one request are refined as well.
    """
    # all are used by several branches below
    clean = stored(sources.select("source_id", dc.clean_markdown(F.col("text")).alias("text")), "clean")
    ok = clean.filter("text IS NOT NULL")
    rows = stored(dc.lines(ok), "lines")
    totals = rows.groupBy("source_id").agg(F.max("line_no").alias("total_lines"))
    structural = stored(dc.outline(dc.headings(rows), totals).withColumn("node_type", F.lit("structural")), "outline")
    why = stored(dc.triggers(structural, ok, max_chars), "triggers")
    asked = stored(ok.join(why.filter("reasons NOT IN ('', 'E')").select("source_id"), "source_id", "left_semi"), "asked")
    semantic = stored(placed(refine.merge_overlaps(sketch.sections(asked, provider, usable), ["source_id"])), "semantic")
    most = pv.request_chars(usable)
    of = lambda df, keys: df.join(keys.select("source_id").distinct(), "source_id", "left_semi")
    several = asked.filter(F.char_length("text") > most)
    deep = refine.refine(of(semantic, several), of(rows, several), provider, max_chars, most, split_given=True)
    semantic = stored(semantic.join(several.select("source_id"), "source_id", "left_anti").unionByName(deep), "semantic-refined")
    long = why.filter("reasons = 'E'")
    mixed = stored(refine.refine(of(structural, long), of(rows, long), provider, max_chars, most), "mixed")
    made = semantic.select("source_id").distinct().withColumn("_semantic", F.lit(True)).join(mixed.filter("node_type = 'semantic'").select("source_id").distinct().withColumn("_mixed", F.lit(True)), "source_id", "full")
    kind = F.when(F.col("_mixed"), "mixed").when(F.col("_semantic"), "semantic").otherwise("structural")
    kinds = why.join(made, "source_id", "left").select("source_id", "reasons", kind.alias("outline_type"))
    as_they_were = of(structural, kinds.filter("outline_type = 'structural' AND reasons <> 'E'"))
    nodes = functools.reduce(DataFrame.unionByName, [as_they_were.select(*refine.NODE, "position"), semantic, mixed])
    out = clean.join(kinds, "source_id", "left").select("source_id", F.when(F.col("text").isNull(), "failed").otherwise("completed").alias("status"), F.char_length("text").cast("bigint").alias("word_count"), "reasons", "outline_type")
    return Processed(out, nodes)


def retry(sources: DataFrame, outlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed sources become pending again and lose their outlines; others stay as they are."""
    failed = sources.filter("status = 'failed'").select("source_id")
    return sources.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status"))), outlines.join(failed, "source_id", "left_anti")


def extractable(sources: DataFrame) -> DataFrame:
    """Only completed sources are handed on to extraction."""
    return sources.filter("status = 'completed'")


def segments(nodes: DataFrame, rows: DataFrame, min_chars: int) -> DataFrame:
    """The leaves of an outline as segments: contents tables dropped, small ones merged, each with its deepest node or null.

    ``rows``: source_id, line_no, line. A leaf's text is gathered from its own lines, for the contents test.
    """
    leaf = refine.bodies(tree.leaves(nodes), rows)
    raw = leaf.filter(~dc.is_contents(F.col("title"), F.col("text"))).select("source_id", "line_start", "line_end", "title")
    return matched(dc.merge_small(dc.sized(raw, rows), min_chars), nodes)


def matched(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``outline_line``, the start of the deepest node whose lines hold the segment's; null if none does."""
    named = nodes.select("source_id", "line_start", "line_end", "level", F.col("line_start").alias("outline_line"))
    return tree.deepest(parts.select("source_id", "line_start", "line_end", "title"), named, "outline_line")
