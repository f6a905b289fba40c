import math

import pytest
from pyspark.sql import functions as F

from lorespark.llm import mix_sources as ms


def quantile(u, m):
    k, p, c = 0, math.exp(-m), math.exp(-m)
    while c <= u and k < 100:
        k += 1
        p *= m / k
        c += p
    return k


def poisson_quantile(u, mean):
    parts = ms.poisson_parts(mean)
    return ms.poisson_draw(u, parts, ms.poisson_cdf(mean / parts))


def test_quantile(spark):
    cases = [(u, m) for u in (0.0, 0.1, 0.5, 0.9, 0.999, 0.9999999) for m in (0.0, 0.01, 0.5, 1.0, 3.7, 16.0)]
    df = spark.createDataFrame(cases, "u double, m double").select("u", "m", poisson_quantile(F.col("u"), F.col("m")).alias("k"))
    for r in df.collect():
        assert r["k"] == quantile(r["u"], r["m"]), r
    df = spark.range(4000).select(poisson_quantile(ms.uniform("id"), F.lit(40.0)).alias("k")).agg(F.mean("k"), F.variance("k")).first()
    assert abs(df[0] - 40) < 0.5 and abs(df[1] - 40) < 4


def test_shares_and_repeatability(spark):
    rows = [(i, f"text {i}", ("a" if i % 3 else "b") if i % 50 else None, 5) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(5)
    out = ms.mix_sources(docs, {"a": 0.3, "b": 0.6, None: 0.1}, scale=0.5)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = sum(got.values())
    assert abs(total - 4500) < 250
    for source, share in (("a", 0.3), ("b", 0.6), (None, 0.1)):
        assert abs(got[source] / total - share) < 0.03
    again = ms.mix_sources(docs.repartition(2), {"a": 0.3, "b": 0.6, None: 0.1}, scale=0.5)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert out.groupBy("doc_id").agg((F.max("copy") + 1 - F.count("*")).alias("x")).filter("x != 0").count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x", "a"), (2, "", None)], "doc_id long, text string, source string")
    assert ms.mix_sources(docs, {"a": 1.0}).filter("source IS NULL").count() == 0
    assert ms.mix_sources(docs.limit(0)).collect() == []
    assert ms.mix_sources(docs, {"zz": 1.0}).collect() == []
    with pytest.raises(ValueError):
        ms.mix_sources(docs, {"a": -1.0})
