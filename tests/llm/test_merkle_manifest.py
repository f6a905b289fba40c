import hashlib

from pyspark.sql import functions as F

from lorespark.llm import merkle_manifest as mm


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """The root and, for each leaf, its siblings from the bottom up."""
    proofs, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = i - i % 3
            proofs[leaf] += [level[j] for j in range(run, min(run + 3, len(level))) if j != i]
            at[leaf] = i // 3
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def expected(rows):
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*map(enc, r))))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[2] for x in sorted(of[s])]) for s in names}
    root, upper = tree([subs[s][0] for s in names])
    return sorted(
        (str(i if has else None), h, subs[s][0], root, H(*proof, *upper[k]))
        for k, s in enumerate(names) for (has, i, h), proof in zip(sorted(of[s]), subs[s][1], strict=True)
    )


def got(out):
    rows = out.withColumns({"proof": mm.proof_digest(F.col("levels")), "again": mm.folded(F.col("leaf"), F.col("levels"))}).collect()
    assert all(r["again"] == r["root"] for r in rows)
    return sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in rows)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_groups_of_every_size(spark):
    sizes = {"a": 1, "b": 2, "": 3, "é": 4, "Z": 82, None: 10, "zz": 244}
    rows = [(1000 - i, s, "en" if i % 3 else None, i, None if i % 7 == 0 else f"täxt\n{i}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(mm.merkle_manifest(df)) == expected(rows)


def test_many_groups(spark):
    rows = [(i, f"source {i % 100}", "en", 3, "abc") for i in range(150)]
    assert got(mm.merkle_manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_null_and_repeated_ids_and_rows(spark):
    rows = [(None, "a", "en", 1, f"t{i}") for i in range(20)] + [(5, "a", None, None, None)] * 7 + [(5, "a", "", 0, ""), (-3, "a", "en", 1, "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "at": F.lit("x"), "digest": F.lit(None).cast("string")})
    assert got(mm.merkle_manifest(df)) == expected(rows)


def test_tampering_shows(spark):
    rows = [(i, "a", "en", 1, f"line {i}\nline") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    text = F.when(F.col("doc_id") == 4, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = mm.merkle_manifest(df, carried={"claim": mm.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])})
    bad = out.filter(mm.folded(F.col("claim"), F.col("levels")) != F.col("root")).collect()
    assert [r["id"] for r in bad] == [4]


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(1, "a", "en", 1, "x")], SCHEMA)
    assert mm.merkle_manifest(df.limit(0)).collect() == []
    only = mm.merkle_manifest(df.drop("lang")).first()
    assert only["leaf"] == only["subroot"] == only["root"] == H(enc(1), enc("a"), "-", enc(1), enc("x")) and only["levels"] == []


def test_node_table(spark):
    leaves = spark.createDataFrame([("t", i, 30, H(str(i))) for i in range(30)], "tree string, at long, n long, digest string")
    nodes = mm.node_table(leaves).groupBy("level").count().collect()
    assert {r["level"]: r["count"] for r in nodes} == {0: 30, 1: 10, 2: 4, 3: 2, 4: 1}
