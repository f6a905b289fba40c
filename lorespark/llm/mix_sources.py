"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source of weight w is to make up the share w of the mix. With N documents that are not of a
weightless source, n of them of the source, its documents have the target repetition rate
``scale * w * N / n``. Each document's count is a Poisson variable of that mean: a hash of
(seed, id, source, text) gives a uniform number, and the count is the number of values of the
distribution function, an array that each source has once, that don't exceed it. Means over
``MAX_MEAN`` are split into equal parts whose counts add up. Each document is exploded by its count, and a hash
of (seed, id, text, copy) deals the copies to partitions and orders them there, which is a
global shuffle that repeats exactly if an executor is lost.

The counts of sources are pre-aggregated; nothing is grouped by source afterwards, so that a
source with a third of all rows is no hot group: rates of at most ``MAX_BROADCAST`` sources, whose
number is checked, are broadcast; more are joined by a shuffle whose large partitions Spark splits. The shuffle's key is a hash of the copy.

``weights``: source to weight, not negative, scaled to sum to one over the sources present; None
gives all sources the same weight. Sources that are not named get ``other`` each. A null source
is a source of its own, named by None. Repeated rows get equal counts. Columns pass through;
``copy`` (from 0) and ``shuffle_key`` are added and replace input columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, named, packed


#: Sources whose rates are broadcast at most, under 600 bytes each: 30 MB.
MAX_BROADCAST = 50_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash, in steps of 2^-53."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


#: Parts of a mean have this at most, so that exp(-mean) can't vanish.
MAX_MEAN = 16.0


def poisson_cdf(mean: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, ..., up to the first value that no number below 1 reaches."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), zero,
        lambda s, i: F.struct((s["p"] * mean / i).alias("p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + s["p"] * mean / i).alias("cdf")),
        lambda s: s["cdf"],
    )
    # steps that add nothing in double precision are left out, so that a draw compares with few values
    return F.array_distinct(walked)


def poisson_parts(mean: Column) -> Column:
    return F.greatest(F.ceil(mean / MAX_MEAN), F.lit(1)).cast("int")


def poisson_draw(u: Column, parts: Column, cdf: Column) -> Column:
    """The least k with a distribution function over ``u``, for each of ``parts`` equal parts of the mean; their sum.

    The first part takes ``u``, each other one a uniform number that is made from it.
    """

    def one(v: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: c <= v))

    added = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda s, i: s + one(F.when(i == 1, u).otherwise(uniform(F.lit("part"), i, u))))
    return F.when(parts == 1, one(u)).otherwise(added)


def source_rates(docs: DataFrame, weights: dict | None, other: float, scale: float, source_col: str) -> DataFrame:
    """``of`` (a source), ``n``, ``rate`` for each source."""
    counts = docs.groupBy(named(source_col).cast("string").alias("of")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        if any(w < 0 or math.isnan(w) for w in [*weights.values(), other]):
            raise ValueError("weights must not be negative")
        weight = F.lit(float(other))
        for name, w in weights.items():
            weight = F.when(F.col("of").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("weight", weight)
    totals = counts.agg(F.sum("weight").alias("all_weight"), F.sum(F.when(F.col("weight") > 0, F.col("n"))).alias("all_n"))
    rate = F.when(F.col("weight") > 0, F.lit(float(scale)) * F.col("weight") / F.col("all_weight") * F.col("all_n") / F.col("n")).otherwise(0.0)
    # totals is one row
    return counts.join(F.broadcast(totals), F.lit(True)).select("of", "n", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict | None = None, other: float = 0.0, scale: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    rest = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    parts = poisson_parts(F.col("rate"))
    rates = source_rates(docs, weights, other, scale, source_col)
    rates = materialize(rates.select("of", "rate", parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf")), "rates").select("of", "parts", "cdf")
    if rates.count() <= MAX_BROADCAST:
        rates = F.broadcast(rates)
    who = F.xxhash64(F.lit(seed), named(id_col), named(source_col), named(text_col))
    rows = docs.select(packed(docs, ("copy", "shuffle_key")).alias("row"), named(source_col).cast("string").alias("from"), who.alias("who"))
    joined = rows.join(rates, F.col("from").eqNullSafe(F.col("of")))
    count = poisson_draw(uniform(F.col("who")), F.col("parts"), F.col("cdf"))
    copies = joined.withColumn("count", count).filter("count > 0").select("row", "who", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    dealt = copies.select("row", F.col("copy").cast("bigint").alias("copy"), F.xxhash64(F.lit("order"), "who", "copy").alias("shuffle_key"))
    dealt = dealt.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return dealt.select(*(F.col("row").getField(c).alias(c) for c in rest), "copy", "shuffle_key")
