import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lorespark.llm import resample as rs


def tables(spark, n=400):
    rnd = random.Random(1)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    both = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        ok = i % 4 != 0
        rows.append((i, " ".join(rnd.choices(both, k=30) + rnd.choices(good if ok else bad, k=10)), "k"))
        if i % 2:
            labels.append((i, int(ok), 0))
        elif i % 8 == 0:
            labels.append((i, 0, 1))
    rows += [(n, None, None), (n + 1, "", ""), (None, rows[1][1], "z"), rows[2]]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_good_documents_are_selected_on_held_out_rows(spark):
    docs, labels = tables(spark)
    got = rs.importance_resample(docs, labels, share=0.75).filter("doc_id < 400").collect()
    held = [r for r in got if r["doc_id"] % 2 == 0 and r["doc_id"] % 8]
    assert sum(r["selected"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) >= 0.9


def test_top_k_is_exact_and_repeats(spark):
    docs, labels = tables(spark)
    for share in (0.0, 0.33, 1.0):
        rows = rs.importance_resample(docs, labels, share=share).collect()
        k = round(share * len(rows))
        keys = sorted((r["noisy_weight"] for r in rows), reverse=True)
        want = sum(x >= keys[k - 1] for x in keys) if k else 0
        assert sum(r["selected"] for r in rows) == want and want - k in (0, 1)
    again = rs.importance_resample(docs.repartition(5), labels, share=0.33).collect()
    assert sorted(map(str, again)) == sorted(map(str, rs.importance_resample(docs, labels, share=0.33).collect()))


def test_threshold_against_sort(spark):
    rnd = random.Random(4)
    keys = [rnd.choice([rnd.randrange(-(2**63), 2**63), rnd.randrange(-5, 5), 2**63 - 1, -(2**63)]) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in keys], "key long")
    for k in (1, 2, 150, 300):
        assert rs._threshold(df, k) == sorted(keys, reverse=True)[k - 1]


def test_gumbel_samples_in_proportion(spark):
    """With no target all weights are equal, so each row is as likely to be taken."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rs.importance_resample(docs, labels, share=0.25).collect()
    assert all(r["log_weight"] == 0 for r in got)
    ids = np.array([r["doc_id"] for r in got if r["selected"]])
    assert len(ids) == 500 and abs(ids.mean() - 1000) < 80


def slow_features(text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    kinds = [["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or not c.isascii() else "0" if c.isdigit() else c for c in w] for w in words]
    shapes = ["".join(c for i, c in enumerate(k) if not (i and c == k[i - 1] and c in "Aa0")) for k in kinds]
    return collections.Counter([("w", w) for w in lower] + [("ww", *p) for p in zip(lower, lower[1:])] + [("s", x) for x in shapes] + [("ss", *p) for p in zip(shapes, shapes[1:])])


def test_weights_against_plain_counts(spark):
    rnd = random.Random(6)
    bits = ["ab", "Ab", "é1", "x#", "x##", "QQ!", "12", "cd", "ef", "gh", "a-b"]
    rows = [(i, " ".join(rnd.choices(bits[: 6 if i % 3 else 11], k=rnd.randrange(0, 14))) + rnd.choice(["", "\n", "\tz"])) for i in range(60)] + [(60, None)]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(50)]
    target = {i for i, q, t in labels if q and not t}
    have = {i: slow_features(t or "") for i, t in rows}
    got = rs.importance_resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in got:
        want, d = 0.0, r["doc_id"]
        for f, t in have[d].items():
            others = [i for i in have if i != d and f in have[i]]
            g = sum(i in target for i in others)
            e = len(others) * (len(target) - (d in target)) / (len(have) - 1)
            z = abs(g - e) / math.sqrt(e + 1)
            want += math.log((g + rs.SMOOTHING) / (e + rs.SMOOTHING)) * z**4 / (z**4 + rs.SHRINK**4) * (1 + math.log(t))
        assert abs(r["log_weight"] - want) < 1e-4 and r["n_grams"] == sum(have[d].values()), (d, r, want)


def test_targets_stay(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r["selected"] for r in rs.importance_resample(docs, labels, keep=0.9).collect()}
    target = [r["doc_id"] for r in labels.filter("quality = 1 AND toxic = 0").collect()]
    assert 0.9 <= sum(got[i] for i in target) / len(target) < 0.95
    none = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["selected"] for r in rs.importance_resample(docs, none).collect())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rs.importance_resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
