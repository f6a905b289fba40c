"""Filters, lookups and changes of the knowledge store's tables; every change returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.operators.tree import deepest
from lorespark.sources.shared import stored


def in_domains(sources: DataFrame, domain_ids: list[str]) -> DataFrame:
    """Sources of the domains, and those without one; no domains means all."""
    return sources.filter(F.col("domain_id").isin(domain_ids) | F.col("domain_id").isNull()) if domain_ids else sources


def choose(candidates: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Candidates that a chooser named; all of them if it named none of them."""
    hit = candidates.join(chosen.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    any_hit = hit.agg(F.max("_hit").alias("_any"))  # one row
    return hit.crossJoin(any_hit).filter("_hit = 1 OR _any IS NULL").drop("_hit", "_any")


def listing(df: DataFrame, where: dict[str, object], order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that equal all values given (None: any), sorted, one page of them."""
    for name, value in where.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` that have the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def upsert_add(old: DataFrame, new: DataFrame, keys: list[str], counter: str, latest: list[str]) -> DataFrame:
    """Counters add up; other columns take the new value where there is one."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    return joined.select(
        *(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys),
        (F.coalesce(f"o.{counter}", F.lit(0)) + F.coalesce(f"n.{counter}", F.lit(0))).alias(counter),
        *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in latest),
    )


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def delete_cascade(tables: dict[str, DataFrame], source_ids: DataFrame) -> dict[str, DataFrame]:
    """The five tables without the sources' rows: sources, outlines, units, points, relations."""
    units = stored(tables["units"].join(source_ids, "source_id", "left_semi").select("unit_id").distinct(), "gone-units")
    # written, as it is asked twice; points go by their units, which are fewer
    gone = stored(tables["points"].join(units, "unit_id", "left_semi").select("point_id"), "gone")
    rel = tables["relations"].join(gone, F.col("source_point") == F.col("point_id"), "left_anti").join(gone, F.col("target_point") == F.col("point_id"), "left_anti")
    out = {k: v.join(source_ids, "source_id", "left_anti") for k, v in tables.items() if "source_id" in v.columns}
    return {**out, "points": tables["points"].join(units, "unit_id", "left_anti"), "relations": rel}


def keep_newest(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows, found by a top-n rather than a sort of all rows."""
    return df.orderBy(*order).limit(n)


def latest_open(turns: DataFrame) -> DataFrame:
    """Of each session the last turn without an answer."""
    w = W.partitionBy("session_id").orderBy(F.desc("turn_index"))
    return turns.filter("answer_id IS NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def next_turn_index(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg((F.coalesce(F.max("turn_index"), F.lit(0)) + 1).alias("next_index"))


def leaves(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Nodes that are no node's parent."""
    parents = nodes.select(F.col(parent).alias("_p")).filter("_p IS NOT NULL").distinct()
    return nodes.join(parents, nodes[key] == F.col("_p"), "left_anti")


def descendants(nodes: DataFrame, key: str, parent: str, seeds: DataFrame) -> DataFrame:
    """``seed`` and each node at or below it, to the end of every path; a cycle is walked once.

    Each level is one join, written to the shared folder, of nodes that weren't there before.
    """
    from lorespark.sources.shared import stored

    child = nodes.select(F.col(key).alias("_child"), F.col(parent).alias(key))
    found = front = stored(seeds.select(F.col(key).alias("seed"), F.col(key)).distinct(), "below")
    while not front.isEmpty():
        step = front.join(child, key).select("seed", F.col("_child").alias(key)).distinct()
        front = stored(step.join(found, ["seed", key], "left_anti"), "below")
        found = found.unionByName(front)
    return found


def closure(nodes: DataFrame, key: str, parent: str, seeds: DataFrame) -> DataFrame:
    """Seeds and all their descendants."""
    return descendants(nodes, key, parent, seeds).select(key).distinct()


def neighbours(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Points one step away over relations that don't contradict: outgoing ones, and incoming ones if bidirectional."""
    ok = relations.filter("relation_type <> 'contradicts'")
    out = ok.join(seeds.select(F.col("point_id").alias("source_point")), "source_point", "left_semi").select(F.col("target_point").alias("point_id"))
    back = ok.filter("direction = 'bidirectional'").join(seeds.select(F.col("point_id").alias("target_point")), "target_point", "left_semi").select(F.col("source_point").alias("point_id"))
    return out.unionByName(back).distinct()


def conflicts(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Points that contradict a seed, in either direction."""
    bad = relations.filter("relation_type = 'contradicts'")
    out = bad.join(seeds.select(F.col("point_id").alias("source_point")), "source_point", "left_semi").select(F.col("target_point").alias("point_id"))
    back = bad.join(seeds.select(F.col("point_id").alias("target_point")), "target_point", "left_semi").select(F.col("source_point").alias("point_id"))
    return out.unionByName(back).distinct()


def deepest_container(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each segment's deepest node of the same source whose lines hold the segment's; the first of equal ones; null if none."""
    named = nodes.select("source_id", "line_start", "line_end", "level", F.col("outline_id").alias("container"))
    return deepest(segments.select("source_id", "line_start", "line_end").distinct(), named, "container")


def delete_failed(sources: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources that stay, and those of ``asked`` (source_id) that go: only failed ones may."""
    gone = sources.filter("status = 'failed'").join(asked, "source_id", "left_semi").select("source_id")
    return sources.join(gone, "source_id", "left_anti"), gone


def status_times(changes: DataFrame) -> DataFrame:
    """Per source the latest status and when it began and ended, from changes (source_id, status, at): each status sets its own time stamp."""
    at = lambda *kinds: F.max(F.when(F.col("status").isin(*kinds), F.col("at")))
    return changes.groupBy("source_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), at("processing").alias("started_at"), at("completed", "failed").alias("ended_at"))


def pending_migrations(migrations: DataFrame, applied: DataFrame) -> DataFrame:
    """Migrations (version, name) that weren't applied yet; each runs once, in the order of the versions."""
    return migrations.join(applied.select("version"), "version", "left_anti").orderBy("version")


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of sorted rows, from number 1, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return listing(df, {}, order, size, size * (number - 1)).join(F.broadcast(total), F.lit(True))


def append(df: DataFrame, path: str) -> None:
    """One batch as one job: its rows appear together when the job ends."""
    df.write.mode("append").parquet(path)


def natural_key(*columns: Column) -> Column:
    """An id that follows from the row's own values, so that a job that runs again makes the same one."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def update_columns(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` that aren't null replace those of the row with the same key."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    joined = old.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in old.columns))


def valid_units(units: DataFrame, points: DataFrame) -> DataFrame:
    """Units with a center and at least one point, none of them empty."""
    sums = points.groupBy("unit_id").agg(F.count("*").alias("n_points"), F.bool_and(F.trim(F.coalesce("content", F.lit(""))) != "").alias("_full"))
    return units.filter("trim(coalesce(center, '')) <> ''").join(sums.filter("_full").drop("_full"), "unit_id")


def ranked(df: DataFrame, by: str, score: Column, tie: str) -> DataFrame:
    """Ranks from 0 by falling score within ``by``; equal scores by ``tie``."""
    return df.withColumn("rank", (F.row_number().over(W.partitionBy(by).orderBy(score.desc(), tie)) - 1).cast("bigint"))
