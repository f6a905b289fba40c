"""Document ETL: Markdown to lines, headings, outlines, segments and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean_markdown(text):
    """Line ends as LF; zero-width characters and HTML comments dropped."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, "[​‌‍﻿]", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


HEADING = r"^#{1,6}\s+\S"


def lines(docs: DataFrame) -> DataFrame:
    """``source_id, line_no`` (from 1) and ``line``."""
    return docs.select("source_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("source_id", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def fenced(rows: DataFrame) -> DataFrame:
    """Adds ``is_fence`` and ``in_code``, by the parity of the fences so far."""
    return coded(rows.withColumn("is_fence", F.ltrim("line").startswith("```")))


def coded(out: DataFrame) -> DataFrame:
    """Adds ``in_code`` to lines with ``is_fence``; of the lines between fences any may be left out."""
    w = W.partitionBy("source_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    return out.withColumn("in_code", ~F.col("is_fence") & (F.sum(F.col("is_fence").cast("int")).over(w) % 2 == 1))


def break_priorities(rows: DataFrame) -> DataFrame:
    """0 in code and tables, 1 text, 2 blank, 3 heading."""
    out = fenced(rows)
    rank = F.when(F.col("is_fence") | F.col("in_code") | F.trim("line").startswith("|"), 0).when(F.col("line").rlike(r"^#{1,6}\s+\S"), 3).when(F.trim("line") == "", 2).otherwise(1)
    return out.select("source_id", "line_no", rank.alias("priority"))


def headings(rows: DataFrame) -> DataFrame:
    """Headings outside code, their level capped at 4."""
    level = F.least(F.char_length(F.regexp_extract("line", "^(#+)", 1)), F.lit(4)).cast("bigint")
    fence, like = F.ltrim("line").startswith("```"), F.col("line").rlike(HEADING)
    # fences and what may be a heading are all that the parity needs; other lines aren't shuffled
    own = rows.filter(fence | like).select("source_id", "line_no", fence.alias("is_fence"), F.when(~fence, level).alias("level"), F.when(~fence, F.trim(F.regexp_replace("line", "^#+", ""))).alias("title"))
    return coded(own).filter(~F.col("is_fence") & ~F.col("in_code")).select("source_id", "line_no", "level", "title")


def outline(heads: DataFrame, totals: DataFrame) -> DataFrame:
    """End line, parent (the latest earlier heading of a lower level) and place among siblings of each heading."""
    w = W.partitionBy("source_id").orderBy("line_no")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    found = [F.last(F.when(F.col("level") == k, F.struct("line_no", "level")), ignorenulls=True).over(before) for k in (1, 2, 3)]
    parent = F.greatest(*(F.when(F.col("level") > k, x) for k, x in zip((1, 2, 3), found)))
    out = heads.join(totals, "source_id").select("*", parent.alias("parent"), F.coalesce(F.lead("line_no").over(w) - 1, F.col("total_lines")).alias("line_end"))
    place = F.row_number().over(W.partitionBy("source_id", "parent.line_no").orderBy("line_no")) - 1
    return out.select("source_id", F.col("line_no").alias("line_start"), "line_end", "level", "title", F.col("parent.line_no").alias("parent_line"), F.col("parent.level").alias("parent_level"), place.cast("bigint").alias("position"))


def virtual_headings(heads: DataFrame) -> DataFrame:
    """Levels that are skipped from a heading to the next one, to be inserted before the latter."""
    w = W.partitionBy("source_id").orderBy("line_no")
    out = heads.withColumn("prev", F.lag("level").over(w)).filter("level > prev + 1")
    return out.select("source_id", "line_no", F.explode(F.sequence(F.col("prev") + 1, F.col("level") - 1)).alias("level"))


def repair_sections(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """Clamped to the document and to levels 1 to 3, and sorted; a section ends right before the next one if that is of its level."""
    s = sections.join(totals, "source_id")
    s = s.select("source_id", "title", F.greatest("line_start", F.lit(1)).alias("line_start"), F.least("line_end", "total_lines").alias("line_end"), F.greatest(F.least("level", F.lit(3)), F.lit(1)).alias("level"), "total_lines")
    s = s.filter("line_start <= line_end AND trim(title) <> ''")
    w = W.partitionBy("source_id").orderBy("line_start", "level", "title")
    same = F.lead("level").over(w) == F.col("level")
    s = s.withColumn("fixed", F.when(same, F.greatest(F.lead("line_start").over(w) - 1, F.col("line_start"))).otherwise(F.col("line_end")))
    top = F.min("level").over(W.partitionBy("source_id"))
    last = F.row_number().over(W.partitionBy("source_id").orderBy("level", F.desc("line_start"), F.desc("title")))
    s = s.withColumn("top", top).withColumn("last", last)
    end = F.when((F.col("level") == F.col("top")) & (F.col("last") == 1), F.col("total_lines")).otherwise(F.col("fixed"))
    return s.select("source_id", "title", "line_start", end.alias("line_end"), "level")


def line_chars(rows: DataFrame) -> DataFrame:
    """``source_id, line_no, until``: characters of a source's lines up to and with each, newlines too."""
    # lengths before the shuffle, which else takes the lines along
    sizes = rows.select("source_id", "line_no", (F.char_length("line") + 1).alias("n"))
    return sizes.select("source_id", "line_no", F.sum("n").over(W.partitionBy("source_id").orderBy("line_no")).alias("until"))


def sized(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``before`` and ``until``, the characters before a segment and up to its end, so that any stretch's size is a difference."""
    cum = line_chars(rows)
    a = cum.select("source_id", (F.col("line_no") + 1).alias("line_start"), F.col("until").alias("before"))
    b = cum.select("source_id", F.col("line_no").alias("line_end"), "until")
    return parts.join(a, ["source_id", "line_start"], "left").fillna({"before": 0}).join(b, ["source_id", "line_end"])


def triggers(nodes: DataFrame, docs: DataFrame, max_chars: int) -> DataFrame:
    """Why a document's outline needs refining: A none, B sparse, C coverage, D flat, E long leaves."""
    from lorespark.operators.tree import leaves

    size = sized(leaves(nodes), lines(docs)).groupBy("source_id").agg(F.max(F.col("until") - F.col("before") - 1).alias("longest"))
    sums = nodes.groupBy("source_id").agg(F.count("*").alias("n"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("covered"), (F.min("level") == F.max("level")).alias("flat"))
    d = docs.select("source_id", F.char_length("text").alias("chars"), F.size(F.split("text", "\n")).alias("total"))
    d = d.join(sums, "source_id", "left").join(size, "source_id", "left")
    none = F.col("n").isNull()
    flags = F.array_compact(F.array(
        F.when(none, "A"), F.when((F.col("n") < 3) & (F.col("chars") > 2000), "B"), F.when(F.col("covered") / F.col("total") < 0.5, "C"),
        F.when((F.col("n") < 5) & F.col("flat"), "D"), F.when(F.col("longest") > max_chars, "E"),
    ))
    return d.select("source_id", F.array_join(flags, "").alias("reasons"))


def is_contents(title, text):
    """A table of contents: by its title, or if over 70 % of its lines that aren't blank are links to anchors."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    links = F.filter(rows, lambda x: x.startswith("- [") & F.contains(x, F.lit("](#")))
    return F.lower(title).isin("目录", "table of contents", "toc") | F.coalesce(F.try_divide(F.size(links), F.size(rows)) > 0.7, F.lit(False))


def greedy_batches(nodes: DataFrame, budget: int) -> DataFrame:
    """Numbers nodes with batches of a token budget, in order; a node that alone exceeds it is a batch."""
    arr = nodes.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "tokens"))).alias("a"))
    step = lambda s, x: F.when((s["held"] > 0) & (s["held"] + x["tokens"] > budget), F.struct((s["batch"] + 1).alias("batch"), x["tokens"].alias("held"), F.array_append(s["out"], s["batch"] + 1).alias("out"))).otherwise(
        F.struct(s["batch"].alias("batch"), (s["held"] + x["tokens"]).alias("held"), F.array_append(s["out"], s["batch"]).alias("out"))
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<bigint>").alias("out"))
    arr = arr.withColumn("b", F.aggregate("a", zero, step, lambda s: s["out"]))
    return arr.select("source_id", F.explode(F.arrays_zip("a", "b")).alias("z")).select("source_id", F.col("z.a.line_start").alias("line_start"), F.col("z.b").alias("batch"))


def windows(docs: DataFrame, max_chars: int = 2000, overlap: float = 0.05) -> DataFrame:
    """Windows of each text: ``source_id`` (of any type), ``line_start, line_end``. Greedy windows of lines by character budget, broken at the best place near the end, with overlap.

    Fixed values: the last fifth of a window, ten lines at least, is searched for a break; windows of over
    ten lines overlap by ``overlap`` of their lines, five at least.

    Each step depends on the last one's break, so a document is handled as a whole in pandas.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for source_id, text in zip(pdf["source_id"], pdf["text"]):
                rows = (text or "").split("\n")
                rank = _ranks(rows)
                start = 0
                while start < len(rows):
                    size, end = 0, start
                    while end < len(rows) and (end == start or size + len(rows[end]) + 1 <= max_chars):
                        size += len(rows[end]) + 1
                        end += 1
                    if end < len(rows):
                        first = max(end - max(10, (end - start) // 5), start + 1)
                        ahead = range(end - 1, first - 1, -1)
                        best = max(ahead, key=lambda i: (rank[i], i), default=end)
                        end = best if best < end and rank[best] > 0 else end
                    out.append((source_id, start + 1, end))
                    if end >= len(rows):
                        break
                    n = end - start
                    back = end - (0 if n <= 10 else max(5, int(n * overlap)))
                    start = back if back > start else end
            yield pd.DataFrame(out, columns=["source_id", "line_start", "line_end"])

    kind = docs.schema["source_id"].dataType.simpleString()
    return docs.select("source_id", "text").mapInPandas(run, f"source_id {kind}, line_start bigint, line_end bigint")


def _ranks(rows: list[str]) -> list[int]:
    out, code = [], False
    for line in rows:
        s = line.strip()
        if s.startswith("```"):
            code = not code
            out.append(0)
        elif code or s.startswith("|"):
            out.append(0)
        else:
            head = line.lstrip("#")
            n = len(line) - len(head)
            out.append(3 if 1 <= n <= 6 and head[:1].isspace() and head.strip() else 2 if not s else 1)
    return out


def merge_small(segments: DataFrame, min_chars: int) -> DataFrame:
    """Joins segments of a source that are too small with the next one, and a small last one with the one before.

    ``segments``: source_id, line_start, line_end, title, and ``before`` and ``until``, the characters before a
    segment and up to its end with their newlines, so that a merged one's size counts what lies between.
    """
    arr = segments.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end", F.coalesce("title", F.lit("")).alias("title"), "before", "until"))).alias("a"))
    size = lambda x: x["until"] - x["before"] - 1
    joined = lambda p, x: F.struct(p["line_start"].alias("line_start"), x["line_end"].alias("line_end"), F.when(p["title"] != "", p["title"]).otherwise(x["title"]).alias("title"), p["before"].alias("before"), x["until"].alias("until"))
    kind = "array<struct<line_start:bigint,line_end:bigint,title:string,before:bigint,until:bigint>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast(kind[6:-1]).alias("last"))
    step = lambda s, x: F.when(s["last"].isNull(), F.struct(s["done"].alias("done"), x.alias("last"))).when(size(s["last"]) < min_chars, F.struct(s["done"].alias("done"), joined(s["last"], x).alias("last"))).otherwise(
        F.struct(F.array_append(s["done"], s["last"]).alias("done"), x.alias("last"))
    )
    arr = arr.withColumn("f", F.aggregate("a", zero, step))
    done, last = F.col("f.done"), F.col("f.last")
    prev = F.element_at(done, -1)
    whole = F.struct(prev["line_start"].alias("line_start"), last["line_end"].alias("line_end"), prev["title"].alias("title"), prev["before"].alias("before"), last["until"].alias("until"))
    parts = F.when((F.size(done) > 0) & (size(last) < min_chars), F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), whole)).otherwise(F.array_append(done, last))
    return arr.select("source_id", F.explode(parts).alias("p")).select("source_id", "p.line_start", "p.line_end", "p.title")
