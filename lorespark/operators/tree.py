"""Outlines as trees: roots, groups under a root, long leaves, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.sources.shared import stored


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_line IS NULL")


def root_of(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, root`` of each node, at any depth, by pointer jumping: a round doubles the steps up, so rounds grow with the logarithm of the depth.

    A parent that doesn't exist counts as none. Nodes on or below a cycle have a null root.
    """
    ids = nodes.select(F.col(key).alias("_up")).distinct()
    up = nodes.select(F.col(key), F.col(parent).alias("_up")).join(ids.withColumn("_there", F.lit(True)), "_up", "left")
    up = stored(up.select(key, F.when(F.col("_there"), F.col("_up")).otherwise(F.col(key)).alias("up"), F.coalesce(~F.col("_there"), F.lit(True)).alias("done")), "up")
    for _ in range(max(up.count(), 1).bit_length() + 1):
        if up.filter("NOT done").isEmpty():
            break
        above = up.select(F.col(key).alias("up"), F.col("up").alias("_next"), F.col("done").alias("_root"))
        up = stored(up.join(above, "up").select(key, "_next", (F.col("done") | (F.col("_next") == F.col("up")) & F.col("_root")).alias("done")).withColumnRenamed("_next", "up"), "up")
    return up.select(key, F.when(F.col("done"), F.col("up")).alias("root"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent. A node is known by its source, first line and level."""
    inner = nodes.filter("parent_line IS NOT NULL").select("source_id", F.col("parent_line").alias("line_start"), F.col("parent_level").alias("level")).distinct()
    return nodes.join(inner, ["source_id", "line_start", "level"], "left_anti")


def groups_of_lines(members: DataFrame, nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """Each member's group: the root whose lines, up to the next root, hold the member's; else ``ungrouped``.

    ``members``: source_id, line_start, line_end. One sort by line: the latest root before a member is the only one that can hold it.
    """
    next_ = F.lead("line_start").over(W.partitionBy("source_id").orderBy("line_start")) - 1
    top = roots(nodes).join(totals, "source_id").select("source_id", F.col("line_start").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.coalesce(next_, "total_lines").alias("end"), "title").alias("_root"))
    rows = members.select("source_id", F.col("line_start").alias("_at"), F.lit(1).alias("_kind"), F.struct(*members.columns).alias("_member"))
    latest = F.last("_root", ignorenulls=True).over(W.partitionBy("source_id").orderBy("_at", "_kind"))
    hit = top.unionByName(rows, allowMissingColumns=True).withColumn("_root", latest).filter("_kind = 1")
    held = F.when(F.col("_member.line_end") <= F.col("_root.end"), F.col("_root.title"))
    return hit.select("_member.*", F.coalesce(held, F.lit("ungrouped")).alias("grp"))


def deepest(parts: DataFrame, nodes: DataFrame, value: str, levels: int = 4) -> DataFrame:
    """``parts`` with ``value`` of the deepest node of their source whose lines hold theirs, the first of equal depth; null if none does.

    One sort of a source's ends instead of its parts times its nodes: of each level only nodes that reach further
    than all before them count, so both their starts and their ends ascend, and the one of the least end from a part's
    end on has the least start of all that reach it. ``levels`` is the greatest level.
    """
    before = W.partitionBy("source_id", "level").orderBy("line_start", F.desc("line_end"), value).rowsBetween(W.unboundedPreceding, -1)
    n = nodes.withColumn("_reached", F.max("line_end").over(before)).filter("_reached IS NULL OR line_end > _reached")
    n = n.select("source_id", F.col("line_end").alias("_at"), F.lit(0).alias("_kind"), F.col("level").alias("_level"), F.struct(F.col("line_start").alias("start"), F.col(value).alias("value")).alias("_node"))
    rows = parts.select("source_id", F.col("line_end").alias("_at"), F.lit(1).alias("_kind"), F.struct(*parts.columns).alias("_part"))
    w = W.partitionBy("source_id").orderBy(F.desc("_at"), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    events = n.unionByName(rows, allowMissingColumns=True)
    for k in range(1, levels + 1):
        events = events.withColumn(f"_n{k}", F.last(F.when(F.col("_level") == k, F.col("_node")), ignorenulls=True).over(w))
    found = [F.when(F.col(f"_n{k}.start") <= F.col("_part.line_start"), F.col(f"_n{k}.value")) for k in range(levels, 0, -1)]
    return events.filter("_kind = 1").select("_part.*", F.coalesce(*found).alias(value))


def nested(nodes: DataFrame, levels: int = 4) -> DataFrame:
    """One JSON tree per source, built from the lowest level up; only siblings meet in one row.

    A node's JSON holds its title, line and children in order. ``levels`` is the greatest level.
    """
    done = None
    for level in range(levels, 0, -1):
        here = nodes.filter(F.col("level") == level).select("source_id", "line_start", "parent_line", "parent_level", "title")
        if done is not None:
            kids = done.filter(F.col("parent_level") == level).groupBy("source_id", F.col("parent_line").alias("line_start")).agg(_joined().alias("children"))
            here = here.join(kids, ["source_id", "line_start"], "left")
        else:
            here = here.withColumn("children", F.lit(None).cast("string"))
        body = F.to_json(F.struct("title", F.col("line_start").alias("line")))
        json = F.concat(F.substr(body, F.lit(1), F.char_length(body) - 1), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        here = here.select("source_id", "line_start", "parent_line", "parent_level", json.alias("json"))
        done = here if done is None else done.unionByName(here)
    top = done.filter("parent_line IS NULL").groupBy("source_id").agg(_joined().alias("t"))
    return top.select("source_id", F.concat(F.lit("["), F.col("t"), F.lit("]")).alias("tree"))


def _joined():
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "json"))), lambda x: x["json"]), ",")
