"""A Merkle manifest of a dataset, with a proof for every row looked up by coordinates.

A row's leaf is the digest of its fields. Per group, leaves stand in order of id; every three
consecutive nodes become the digest of their joined digests, level by level, until one is left,
the group's subroot. Subroots in order of group give the root in the same way.

Places: rows are sorted into ranges, so that a group of any size spreads over tasks; a row's
index is its place within its range plus the counts of ranges before it. Nodes: four levels at a
time, each block of at most 81 nodes in one row; every node is written to a table of
(tree, level, at, digest). Proofs: each node of a level that four divides explodes the coordinates
of the siblings that the next four levels need, which follow from its index and the group's size;
they are joined with the node table, ordered and put into levels. A row's proof is its own
four levels and then those of its block, which takes them from its own block: no node is
looked up by more than 81 rows' worth of paths, and the hot upper nodes are asked for once a block.

Defined cases: a null id stands first, a null group is a group of its own and the first one;
a null field is ``-``, so that it differs from an empty one; rows of equal id stand in order of their
leaves, and rows that repeat are leaves of their own. A group of one row has its leaf as subroot.
A missing field counts as null. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, named

ARITY = 3
#: Levels that one step takes: a block has ARITY ** SPAN nodes at most.
SPAN = 4
BLOCK = ARITY**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Mapping[str, Column] | list[Column]) -> Column:
    return digest(*(encoded(c) for c in (fields.values() if isinstance(fields, Mapping) else fields)))


def _div(a: Column, k: int) -> Column:
    return F.call_function("div", a, F.lit(k).cast("bigint"))


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    powers = F.array(*(F.lit(ARITY**i).cast("bigint") for i in range(40)))
    return F.size(F.filter(powers, lambda p: p < n))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``at``, a row's index among the rows of its ``tree``, and ``n``, their number. No tree is gathered in one task."""
    # equal rows can be told apart by nothing, so chance deals them to ranges
    ranged = rows.withColumn("chance", F.rand(17)).repartitionByRange(tree, *order, "chance").sortWithinPartitions(tree, *order, "chance")
    placed = materialize(ranged.drop("chance").withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy(tree, "range").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    # a row for each range and tree in it
    own = "PARTITION BY " + tree
    counts = counts.selectExpr(
        tree, "range", "first",
        f"coalesce(sum(rows) OVER ({own} ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        f"sum(rows) OVER ({own}) AS n",
    )
    return placed.join(counts, [tree, "range"]).withColumn("at", F.col("place") - F.col("first") + F.col("before")).drop("range", "place", "first", "before")


def _runs(below: Column) -> Column:
    """Digests of every run of consecutive ones."""
    starts = F.sequence(F.lit(1), F.size(below), F.lit(ARITY))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(below, i, F.lit(ARITY)), ""), 256))


def _nodes(digests: str, level: int, first: Column) -> Column:
    return F.transform(digests, lambda d, i: F.struct(F.lit(level).alias("level"), (first + i).alias("at"), d.alias("digest")))


def node_table(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees of ``leaves`` (tree, at, n, digest): tree, n, level, at, digest; level 0 has the leaves."""
    out = materialize(leaves.select("tree", "n", F.lit(0).alias("level"), "at", "digest"), "nodes")
    most = out.agg(F.max("n")).first()[0] or 0
    level, all_nodes = 0, out
    while most > ARITY**level:
        left = lambda k, level=level: F.ceil(F.col("n") / F.lit(ARITY ** (level + k)).cast("decimal(20,0)"))
        blocks = out.filter((F.col("level") == level) & (left(0) > 1)).groupBy("tree", "n", _div(F.col("at"), BLOCK).alias("block"))
        blocks = blocks.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("nodes")).withColumn("k0", F.col("nodes")["digest"])
        for k in range(1, SPAN + 1):
            blocks = blocks.withColumn(f"k{k}", F.when(left(k - 1) > 1, _runs(F.col(f"k{k - 1}"))).otherwise(F.array().cast("array<string>")))
        made = F.flatten(F.array(*(_nodes(f"k{k}", level + k, F.col("block") * ARITY ** (SPAN - k)) for k in range(1, SPAN + 1))))
        out = materialize(blocks.select("tree", "n", F.inline(made)), "nodes")
        all_nodes = all_nodes.unionByName(out)
        level += SPAN
    return all_nodes


def proofs(nodes: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``tree, at, levels`` and the other columns of ``roots`` for each leaf; ``levels`` has the place among the run and its other digests.

    ``roots`` (tree, n, levels, ...) says how each tree's path goes on above its root. ``most``: leaves of the largest tree.
    """
    more = [c for c in roots.columns if c not in ("tree", "n", "levels")]
    depth = _depth(F.col("n"))
    top = 0
    while ARITY**top < most:
        top += SPAN
    above = None
    for level in range(top, -1, -SPAN):
        # a tree's root joins at the first step that isn't below it
        ended = roots.filter(F.ceil(depth / SPAN) * SPAN == level).select("tree", F.lit(0).cast("bigint").alias("at"), "levels", *more)
        if above is None:
            above = ended
            continue
        members = nodes.filter((F.col("level") == level) & (depth > level)).select("tree", "n", "at")
        steps = F.sequence(F.lit(level), F.least(F.lit(level + SPAN), depth) - 1)
        wanted = F.flatten(F.transform(steps, lambda x: _siblings(x, level)))
        asked = members.select("tree", "n", F.col("at").alias("from"), F.explode_outer(wanted).alias("want")).select("tree", "n", "from", "want.level", "want.at")
        found = asked.join(nodes.select("tree", "level", "at", "digest"), ["tree", "level", "at"], "left")
        kept = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "at", "digest"))))
        found = found.groupBy("tree", "n", "from").agg(kept.alias("siblings"))
        own = F.transform(steps, lambda x: F.struct(
            (F.call_function("div", F.col("from"), _power(x - level)) % ARITY).cast("int").alias("place"),
            F.transform(F.filter("siblings", lambda s: s["level"] == x), lambda s: s["digest"]).alias("others"),
        ))
        found = found.select("tree", F.col("from").alias("at"), own.alias("own"), _div(F.col("from"), BLOCK).alias("up"))
        upper = above.select("tree", F.col("at").alias("up"), F.col("levels").alias("rest"), *more)
        found = found.join(upper, ["tree", "up"]).select("tree", "at", F.concat("own", "rest").alias("levels"), *more)
        above = found.unionByName(ended)
    return above


def _power(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(ARITY**i).cast("bigint") for i in range(SPAN + 1))), k + 1)


def _siblings(x: Column, level: int) -> Column:
    """Coordinates of the others of the run that holds the node over ``at`` at level ``x``."""
    node = F.call_function("div", F.col("at"), _power(x - level))
    there = F.ceil(F.col("n") / F.element_at(F.array(*(F.lit(ARITY**i).cast("decimal(20,0)") for i in range(40))), x + 1)).cast("bigint")
    first = node - node % ARITY
    run = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(ARITY - 1).cast("bigint")), lambda j: first + j)
    return F.transform(F.filter(run, lambda s: (s != node) & (s < there)), lambda s: F.struct(x.cast("int").alias("level"), s.alias("at")))


def folded(start: Column, levels: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(levels, start, lambda h, l: F.sha2(F.array_join(F.concat(F.slice(l["others"], F.lit(1), l["place"]), F.array(h), F.slice(l["others"], l["place"] + 1, F.lit(ARITY))), ""), 256))


def proof_digest(levels: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(levels, lambda l: l["others"])), ""), 256)


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, carried: Mapping[str, Column] | None = None) -> DataFrame:
    """For each row ``id, leaf, subroot, root, levels`` and what ``carried`` computes from its input row.

    ``levels`` is the proof, to be used by :func:`folded`; digests are lowercase hexadecimal SHA-256.
    """
    carried = dict(carried or {})
    has = {f: named(f) if f in docs.columns else F.lit(None).cast("string") for f in fields}
    tree = F.coalesce(F.concat(F.lit("="), named(group_col).cast("string")), F.lit(""))  # null first, order kept
    rows = docs.select(tree.alias("tree"), named(id_col).alias("id"), leaf(has).alias("digest"), F.struct(F.lit(0).alias("none"), *(c.alias(k) for k, c in carried.items())).alias("more"))
    placed = materialize(numbered(rows, "tree", ["id", "digest"]), "places")
    nodes = node_table(placed)
    subroots = nodes.filter(F.col("level") == _depth(F.col("n"))).select("tree", F.col("n").alias("leaves"), "digest")
    groups = materialize(numbered(subroots.withColumn("all", F.lit("all")), "all", ["tree"]), "groups")
    upper = groups.select(F.col("all").alias("tree"), "n", "at", "digest")
    top = node_table(upper)
    n_groups, largest = groups.agg(F.count("*"), F.max("leaves")).first()
    none = F.array().cast("array<struct<place:int,others:array<string>>>")
    root = top.filter(F.col("level") == _depth(F.col("n"))).select("tree", "n", none.alias("levels"), F.col("digest").alias("root"))
    above = proofs(top, root, n_groups).select(F.col("at").alias("group_at"), "levels", "root")
    roots = groups.join(above, groups["at"] == above["group_at"]).select("tree", F.col("leaves").alias("n"), "levels", "root", F.col("digest").alias("subroot"))
    roots = materialize(roots, "roots")
    paths = proofs(nodes, roots, largest or 0)
    return placed.join(paths, ["tree", "at"]).select("id", F.col("digest").alias("leaf"), "subroot", "root", "levels", *(F.col("more").getField(k).alias(k) for k in carried))
