"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. A window
is ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is
one window. A document's words inside any occurrence of a window are hit. Steps:

1. Every window's shingles (three words, or all of a shorter window) are counted over all
   documents. Windows with a shingle that no document has can't occur and go.
2. A window holds all of its shingles, so that one is a sufficient prefix: the rarest. It is
   joined with the documents' shingles at every position; most positions find nothing.
3. The found position less the shingle's offset is the window's start. It has to lie inside
   the document, and the document's words from there on have to equal the window's.

Steps 2 and 3 have two forms. While the windows have at most ``broadcast_bytes`` they are
broadcast, documents are exploded lazily into positions inside the join's code, and a match is
checked where the words are: only matches are shuffled. Beyond that, rows of (document,
position, hash) are shuffled to the windows' rarest shingles; candidates that come out are
joined with the texts that have any and with their windows' words, and checked there. No row
that is made for a position carries its text.

Matches are told apart by id and a hash of the words. Result: one row per input row with
``doc_id, n_words, n_hit, n_items, items`` (sorted distinct ids as strings) and
``contaminated``. Null texts have no words; items with a null id mark words as hit but are not
listed; repeated rows give repeated results; an empty table of documents gives an empty result,
an empty benchmark no hits. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, named, packed

#: What separates words, as a Java regular expression.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """The words of a text; null has none. ``lower`` is used on plain ASCII only, where it changes A-Z alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _shingle(at: Column, size: int, array: str) -> Column:
    """A hash of ``size`` words from a zero-based position; shorter at the end of the array."""
    return F.xxhash64(F.lit(size), *(F.get(F.col(array), at + i) for i in range(size)))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """A row for each window of each item: the window's number (a hash), its words, the item's id."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("win"))
    return wins.select(F.xxhash64("win").alias("wid"), "win", "item_id").distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(named(id_col).cast("bigint").alias("doc_id"), words(named(text_col)).alias("w"))
    return base.select("doc_id", F.xxhash64("w").alias("mark"), "w")


def _positions(base: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """A row for each word of each document: ``keep``, its place ``at``, and the hash ``key`` of the shingle from there on."""
    at = F.col("at")
    out = base.withColumn("at", F.explode(F.expr("CASE WHEN size(w) > 0 THEN sequence(0, size(w) - 1) ELSE array() END")))
    if len(sizes) == 1:
        return out.select(*keep, "at", _shingle(at, sizes[0], "w").alias("key"))
    return out.select(*keep, "at", F.explode(F.array(*(_shingle(at, k, "w") for k in sizes))).alias("key"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, mark, wid, start, end`` of every occurrence of a window, and ``wid, item_id``."""
    given = materialize(_windows(benchmark, window), "windows")
    windows = given.select("wid", "win").distinct().withColumn("k", F.least(F.size("win"), F.lit(3)))
    size, lengths = windows.agg(F.sum(F.octet_length(F.array_join("win", " ")) + 100), F.collect_set("k")).first()
    small = (size or 0) <= broadcast_bytes
    sizes = sorted(lengths or [3])

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    base = _rows(docs, id_col, text_col)
    positions = F.sequence(F.lit(0), F.size("win") - F.col("k"))
    hashes = F.when(F.col("k") == 1, F.transform(positions, lambda i: _shingle(i, 1, "win"))).when(
        F.col("k") == 2, F.transform(positions, lambda i: _shingle(i, 2, "win"))
    ).otherwise(F.transform(positions, lambda i: _shingle(i, 3, "win")))
    grams = windows.select("wid", F.posexplode(hashes).alias("shift", "key"))
    counts = materialize(_positions(base, sizes).join(near(grams.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("df")), "shingle-counts")
    rare = (
        grams.join(counts, "key", "left").groupBy("wid")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "shift")).alias("r")).filter("r.df > 0")
    )
    prefix = materialize(windows.join(rare, "wid").select(F.col("r.key").alias("key"), F.col("r.shift").alias("shift"), "wid", "win"), "prefixes")

    start = F.col("at") - F.col("shift")
    same = F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("win")) == F.col("win")
    if small:
        found = _positions(base, sizes, "doc_id", "mark", "w").join(near(prefix), "key").withColumn("start", start)
    else:
        slim = prefix.select("key", "shift", "wid", F.size("win").alias("size"))
        found = _positions(base.select("doc_id", "mark", "w"), sizes, "doc_id", "mark").join(slim, "key").withColumn("start", start)
        found = materialize(found.filter("start >= 0").select(F.col("doc_id").alias("of"), F.col("mark").alias("own"), "wid", "start").distinct(), "candidates")
        # the words at each place that is left, of texts that have one: equal rows once
        texts = base.join(found.select("of", "own").distinct(), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("own")), "left_semi").dropDuplicates(["doc_id", "mark"])
        found = found.join(prefix.select("wid", "win"), "wid").join(texts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("own")))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.size("w")) & same)
    found = found.select("doc_id", "mark", "wid", "start", (F.col("start") + F.size("win")).alias("end"))
    return materialize(found, "matches"), given.select("wid", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found, given = matches(docs, benchmark, window, broadcast_bytes, id_col, text_col)
    # hit words: each span, sorted, adds what lies beyond the furthest end so far
    hit = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))), F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n")),
        lambda s: s["n"],
    )
    key = ["doc_id", "mark"]
    spans = found.groupBy(*key).agg(hit.alias("n_hit"))
    items = found.select(*key, "wid").distinct().join(given, "wid").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = spans.join(items.select(F.col("doc_id").alias("of"), F.col("mark").alias("own"), "items"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("own")), "left")
    hits = materialize(hits.select(F.col("doc_id").alias("of"), F.col("mark").alias("own"), "n_hit", "items"), "hits")
    rows = _rows(docs, id_col, text_col).select("doc_id", "mark", F.size("w").alias("n"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("own")), "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "mark", F.col("n").cast("bigint").alias("n_words"), n_hit.cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"), listed.alias("items"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their own columns."""
    found, _ = matches(docs, benchmark, window, broadcast_bytes, id_col, text_col)
    bad = found.select(F.col("doc_id").alias("of"), F.col("mark").alias("own")).distinct()
    rows = docs.select(packed(docs).alias("row"), named(id_col).cast("bigint").alias("doc_id"), F.xxhash64(words(named(text_col))).alias("mark"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("own")), "left_anti").select("row.*")
