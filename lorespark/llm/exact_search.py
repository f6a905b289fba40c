"""Exact top-k search by inner product with a table of distances to pivots.

Components x become floor(64 x). With one more component, sqrt(M^2 - |x|^2) for rows (M is the
greatest norm) and 0 for queries, the distance of a query q and a row x obeys
d^2 = |q|^2 + M^2 - 2 q.x, so that the best scores are the nearest rows, and for any pivot p the
triangle inequality gives d >= abs(d(q, p) - d(x, p)). The distances of every row to up to
``PIVOTS`` pivots are computed once and written; the greatest bound over all pivots is a pair's.

Rows are dealt to the cell of their nearest pivot, and cells to blocks of bounded size by a hash, so
that a cell with any share of the rows is split. A query starts in its own block, where the k-th
score it finds is the bound that other blocks have to beat; a cell whose greatest and least distances to
some pivot rule that out is skipped. Where the block's own distances show that no bound can rule out any of its rows, these are
evaluated at once, many queries together. Elsewhere within a block, candidates are evaluated in order of their
bounds, a share at a time, until the next bound can't beat the k-th score; rounding is allowed for,
and candidates that could tie are evaluated. The k best of all blocks are the result, exactly.

Scores are integers: they are computed in single precision while every partial sum is below
2^24, in double below 2^53, else with Python's integers, and end at the limits of a long, where they count as equal.

Defined cases: vectors null, empty of a component or holding null or non-finite ones take no part, as query or row;
shorter vectors count as filled up with zeros, an empty vector as zero. A row with a null id is a
row, behind others of its score, but no query. Rows that repeat (id and vector) are rows of
their own: they are counted once and multiplied at the end, and a query leaves out itself once. Rows of equal id but other vectors are
other rows. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import least_hashed, materialize, named

SCALE = 64
#: Pivots, chosen far from each other among this many rows of least hash.
PIVOTS, SAMPLE = 32, 2_048
#: A block has about so many rows at most, and about one in so many of all rows, if these are more than the least.
MAX_BLOCK, LEAST_BLOCK, BLOCKS = 65_536, 256, 64
#: Queries that meet a block in one task, about, and at a time within it.
MAX_QUERIES, AT_ONCE = 32_768, 64
#: Allowed for rounding of distances, times the sum of both norms; single precision keeps 6e-8.
SLACK = 1e-6

_ROW = "id long, one long, two long, copies long, cell int, v array<long>, far array<float>"


def quantized(vector: Column) -> Column:
    """floor(64 x) for each component; null where the vector is null or holds a null or non-finite one."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x * SCALE)))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.int64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.empty((0, 0), kind)


def _lift(v: np.ndarray, greatest: float) -> np.ndarray:
    """Rows as doubles with the component that gives all of them the greatest norm."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(greatest**2 - (v * v).sum(1, keepdims=True), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it."""
    chosen = [int(np.argmax((sample * sample).sum(1)))]
    near = _distances(sample, sample[chosen])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def best_of(queries: np.ndarray, floors: np.ndarray, own: np.ndarray, rows: np.ndarray, far: np.ndarray, pivots: np.ndarray, greatest: float, k: int) -> list[tuple[np.ndarray, list[int], int]]:
    """For each query the positions and scores of its ``k`` best rows, those below its floor left out, and how many rows were evaluated.

    ``rows`` stand in order of id, which breaks ties. ``own``: the position of the row that a query leaves out, or -1.
    ``far``: the rows' distances to the pivots, one array for each pivot.
    """
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    most = float(norms.max(initial=0)) * greatest
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    exact = rows.astype(kind)
    asked = queries.astype(kind)
    lifted = np.hstack([queries.astype(np.float64), np.zeros((len(queries), 1))])
    apart = _distances(lifted, pivots).astype(np.float32)
    steps = [min(len(rows), 4 * k), min(len(rows), 64 * k)]
    low, high = far.min(1, initial=np.inf), far.max(1, initial=-np.inf)
    nothing = np.empty(0, np.int64), [], len(rows)
    out = []
    for start in range(0, len(queries), AT_ONCE):
        dense: list[tuple[int, np.ndarray, np.ndarray]] = []
        part = range(start, min(start + AT_ONCE, len(queries)))
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # where no pivot's bound of any row can be beyond what the floor allows, all rows are evaluated at once
        reach = np.array([_reach(norms[j], greatest, floors[j]) for j in part])
        most_apart = np.maximum(np.abs(apart[start : part.stop] - low), np.abs(apart[start : part.stop] - high)).max(1, initial=0)
        all_rows = [j for j, r, m in zip(part, reach, most_apart) if own[j] < 0 and np.isfinite(r) and m <= r]
        over: dict[int, np.ndarray] = {}
        if all_rows:
            together = _limited(asked[all_rows] @ exact.T)
            at_j, at_row = np.nonzero(together >= floors[all_rows][:, None])
            ends = np.searchsorted(at_j, np.arange(len(all_rows) + 1))
            for i, j in enumerate(all_rows):
                over[j] = at_row[ends[i] : ends[i + 1]]
                if len(over[j]):
                    found[j] = (over[j], together[i, over[j]])
        for j in part:
            if j in over:
                continue
            bound = np.zeros(len(rows), np.float32)
            for p in range(len(pivots)):
                np.maximum(bound, np.abs(far[p] - apart[j, p]), out=bound)
            if own[j] >= 0:
                bound[own[j]] = np.inf
            left = np.flatnonzero(np.isfinite(bound))
            at, scores, floor = np.empty(0, np.int64), np.empty(0, kind), floors[j]
            for step in steps:
                # in order of bounds: the next ones, then whether any of the rest can still reach the k-th score
                split = np.argpartition(bound[left], step - 1) if len(left) > step else np.arange(len(left))
                now, left = left[split[:step]], left[split[step:]]
                at, scores = np.concatenate([at, now]), np.concatenate([scores, _limited(exact[now] @ asked[j])])
                if len(scores) >= k:
                    floor = max(floor, _kth(scores, k))
                left = left[bound[left] <= _reach(norms[j], greatest, floor)]
                if not len(left):
                    break
            found[j] = (at, scores)
            if len(left):
                dense.append((j, left, at))
        # of what is left many queries need most rows, so they are evaluated together
        if dense:
            together = _limited(asked[[j for j, _, _ in dense]] @ exact.T)
            for (j, left, at), scores in zip(dense, together, strict=True):
                found[j] = (np.concatenate([at, left]), np.concatenate([found[j][1], scores[left]]))
        for j in part:
            if j in over and not len(over[j]):
                out.append(nothing)
                continue
            at, scores = found[j]
            floor = floors[j] if len(scores) < k else max(floors[j], _kth(scores, k))
            at, scores = at[best := scores >= floor], scores[best]
            order = np.argsort(at, kind="stable")
            order = order[np.argsort(-scores[order], kind="stable")][:k]
            out.append((at[order], [int(s) for s in scores[order]], len(rows) if j in over else len(found[j][0])))
    return out


def _kth(scores: np.ndarray, k: int) -> float:
    return sorted(scores)[-k] if scores.dtype == object else np.partition(scores, -k)[-k]


def _reach(norm: float, greatest: float, floor: float) -> float:
    """The distance up to which a row can have a score of ``floor``."""
    if floor == -np.inf:
        return np.inf
    return float(np.sqrt(max(norm**2 + greatest**2 - 2 * float(floor), 0.0))) * (1 + SLACK) + SLACK * (norm + greatest)


def _limited(scores: np.ndarray) -> np.ndarray:
    """Scores within the limits of a long; only Python's integers can pass them."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if scores.dtype == object else scores


def exact_search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id_col>, score``: the ``k`` rows of greatest score for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = vectors.select(named(id_col).cast("bigint").alias("id"), quantized(named(vector_col)).alias("v")).filter("v IS NOT NULL")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(max(width, 1)) - F.size("v"))))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("copies")).select("id", F.xxhash64("id", "v").alias("one"), F.xxhash64(F.lit(1), "v", "id").alias("two"), "copies", "v")
    rows = materialize(rows, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    is_query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    n, n_queries, greatest = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.sqrt(norm))).first()
    schema = f"query_id long, rank int, `{id_col.replace('`', '``')}` long, score long"
    if not n_queries:
        return spark.createDataFrame([], schema)
    sample = np.array([r["v"] for r in least_hashed(rows.select("v", "one", "two"), "one", SAMPLE, n, "two").collect()] or [rows.select("v").first()["v"]], dtype=np.int64)
    pivots = far_apart(_lift(sample, greatest), PIVOTS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            apart = _distances(_lift(_matrix(b.column("v")), greatest), pivots).astype(np.float32)
            far = pa.ListArray.from_arrays(np.arange(0, apart.size + 1, len(pivots), dtype=np.int32), apart.ravel())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "one", "two", "copies")), pa.array(apart.argmin(1).astype(np.int32)), b.column("v"), far],
                names=["id", "one", "two", "copies", "cell", "v", "far"],
            )

    table = materialize(rows.mapInArrow(measured, _ROW), "pivots")
    # a row for each cell, so as many as pivots at most
    ends = [f(F.get("far", F.lit(p))).alias(f"{name}{p}") for p in range(len(pivots)) for name, f in (("lo", F.min), ("hi", F.max))]
    cells = {r["cell"]: r for r in table.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()}
    size = min(MAX_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    blocks = [-(-cells[c]["n"] // size) if c in cells else 0 for c in range(len(pivots))]
    n_blocks = F.element_at(F.array(*map(F.lit, blocks)), F.col("cell") + 1)
    table = table.withColumn("block", F.pmod("one", n_blocks).cast("int"))
    lo = np.array([[cells[c][f"lo{p}"] if c in cells else 0 for p in range(len(pivots))] for c in range(len(pivots))], np.float32)
    hi = np.array([[cells[c][f"hi{p}"] if c in cells else 0 for p in range(len(pivots))] for c in range(len(pivots))], np.float32)
    groups = max(1, -(-n_queries // MAX_QUERIES))

    def sorted_rows(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.sort_by([("id", "ascending"), ("one", "ascending"), ("two", "ascending")])  # nulls last
        return t, _matrix(t["v"]), np.ascontiguousarray(_matrix(t["far"], np.float32).T)

    def answers(q: pa.Table, found: list, t: pa.Table, q_rows: np.ndarray | None) -> pa.Table:
        """A row for each query, with the lists of what it found."""
        ids, copies = t["id"].to_pylist(), t["copies"].to_numpy()
        lists = {"ids": [], "scores": [], "times": []}
        for j, (at, scores, _) in enumerate(found):
            lists["ids"].append([ids[i] for i in at])
            lists["scores"].append(scores)
            lists["times"].append([int(copies[i]) - (1 if q_rows is not None and q_rows[j] == i else 0) for i in at])
        kinds = pa.list_(pa.int64())
        made = {c: q[c] for c in q.column_names} | {c: pa.array(x, kinds) for c, x in lists.items()}
        return pa.table(made)

    def at_home(t: pa.Table) -> pa.Table:
        t, v, far = sorted_rows(t)
        copies = t["copies"].to_numpy()
        is_q = np.array([x is not None and x % every == 0 for x in t["id"].to_pylist()], bool)
        where = np.flatnonzero(is_q)
        own = np.where(copies[where] == 1, where, -1)
        found = best_of(v[where], np.full(len(where), -np.inf), own, v, far, pivots, greatest, k)
        kept = ["id", "one", "two", "copies", "cell", "block", "v"]
        return answers(t.take(pa.array(where)).select(kept), found, t, where)

    _ANSWER = "id long, one long, two long, copies long, cell int, block int, v array<long>, ids array<long>, scores array<long>, times array<long>"
    home = materialize(table.groupBy("cell", "block").applyInArrow(at_home, _ANSWER), "home")
    floor = F.when(F.size("scores") == k, F.array_min("scores"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries for each cell that can still hold one of their best rows."""
        names = ["id", "one", "two", "copies", "home_cell", "home_block", "v", "floor"]
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            apart = _distances(np.hstack([v.astype(np.float64), np.zeros((len(v), 1))]), pivots)
            floors = b.column("floor").to_pylist()
            reach = np.array([_reach(x, greatest, -np.inf if f is None else f) for x, f in zip(norms, floors, strict=True)])
            for c in range(len(pivots)):
                if not blocks[c]:
                    continue
                bound = np.maximum(np.maximum(lo[c] - apart, apart - hi[c]), 0).max(1)
                if len(to := np.flatnonzero(bound <= reach)):
                    part = b.take(pa.array(to))
                    yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(np.full(len(to), c, np.int32))], names=[*names, "cell"])

    sent = home.select("id", "one", "two", "copies", F.col("cell").alias("home_cell"), F.col("block").alias("home_block"), "v", floor.alias("floor"))
    sent = sent.mapInArrow(onward, "id long, one long, two long, copies long, home_cell int, home_block int, v array<long>, floor long, cell int")
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))).filter("cell <> home_cell OR block <> home_block")
    sent = sent.withColumn("group", F.pmod("two", F.lit(groups)).cast("int")).drop("home_cell", "home_block")
    met = table.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def abroad(t: pa.Table, q: pa.Table) -> pa.Table:
        kept = ["id", "one", "two", "copies"]
        if not t.num_rows or not q.num_rows:
            return answers(q.slice(0, 0).select(kept), [], t, None)
        t, v, far = sorted_rows(t)
        floors = [-np.inf if f is None else f for f in q["floor"].to_pylist()]
        floors = np.array(floors, dtype=object if any(abs(f) >= 1 << 53 for f in floors if f != -np.inf) else np.float64)
        found = best_of(_matrix(q["v"]), floors, np.full(q.num_rows, -1), v, far, pivots, greatest, k)
        some = [j for j, (at, _, _) in enumerate(found) if len(at)]
        return answers(q.take(pa.array(some, pa.int64())).select(kept), [found[j] for j in some], t, None)

    keys = ("cell", "block", "group")
    away = met.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(abroad, "id long, one long, two long, copies long, ids array<long>, scores array<long>, times array<long>")
    pairs = home.drop("v", "cell", "block").unionByName(away)
    pairs = pairs.select("id", "one", "two", "copies", F.explode(F.arrays_zip("ids", "scores", "times")).alias("x")).select("id", "one", "two", "copies", "x.*")
    pairs = pairs.filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    ranked = pairs.selectExpr("*", "row_number() OVER (PARTITION BY id, one, two ORDER BY scores DESC, ids ASC NULLS LAST) AS rank").filter(F.col("rank") <= k)
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return ranked.select(F.col("id").alias("query_id"), "rank", F.col("ids").alias(id_col), F.col("scores").alias("score"))
