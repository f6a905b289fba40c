"""Statistical segmentation: the cheapest path through a lattice of dictionary words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary that is broadcast, about 60 bytes each.
MAX_WORDS = 500_000


def costs(words: DataFrame) -> DataFrame:
    """``word, cost`` of a dictionary (word, freq): a thousand times the negative logarithm of a word's share, whole, so that sums are exact."""
    one = words.filter("word <> '' AND freq > 0").groupBy(F.lower("word").alias("word")).agg(F.sum("freq").alias("freq"))
    total = one.agg(F.sum("freq").alias("total"))  # one row
    return one.join(F.broadcast(total), F.lit(True)).select("word", F.round(1000 * F.log(F.col("total") / F.col("freq"))).cast("bigint").alias("cost"))


def segmented(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``key, tokens`` of texts (key, text): Han runs cut into the words of least total cost, other runs of letters and digits whole; lower-cased.

    A character that is no word costs 1000 more than the dearest word, so that it is the last resort. Of equal paths the one whose last word is longest counts, then the one before it. Each different run is cut once. A text without tokens has an empty list.
    """
    priced = costs(words)
    most, longest, n = priced.agg(F.coalesce(F.max("cost"), F.lit(0)), F.coalesce(F.max(F.char_length("word")), F.lit(1)), F.count("*")).first()
    unknown = most + 1000
    runs = texts.select("key", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{IsHan}]+|[\p{L}\p{Nd}&&[^\p{IsHan}]]+)"))).alias("place", "run"))
    han = runs.filter(F.col("run").rlike(r"^\p{IsHan}")).select("run").distinct()
    spans = han.select("run", F.explode(F.sequence(F.lit(1), F.char_length("run"))).alias("start"))
    spans = spans.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("run") - F.col("start") + 1))).alias("size"))
    spans = spans.withColumn("word", F.substring("run", F.col("start"), F.col("size")))
    priced = F.broadcast(priced) if n <= MAX_WORDS else priced
    edges = spans.join(priced, "word", "left").withColumn("cost", F.coalesce("cost", F.when(F.col("size") == 1, F.lit(unknown)))).filter("cost IS NOT NULL")
    # for each end: the starts and costs of the words that end there
    ending = edges.groupBy("run", (F.col("start") + F.col("size") - 1).alias("end")).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "cost")).alias("into"))
    lattice = ending.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("end", "into"))), lambda x: x["into"]).alias("lattice"))
    # best[i]: cost of the first i characters and the start of their last word
    first = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit(0).alias("start")))
    reach = lambda best, into: F.array_min(F.transform(into, lambda e: F.struct((F.get(best, e["start"] - 1)["cost"] + e["cost"]).alias("cost"), e["start"].alias("start"))))
    paths = lattice.withColumn("best", F.aggregate("lattice", first, lambda best, into: F.array_append(best, reach(best, into))))
    start = F.struct(F.char_length("run").alias("at"), F.array().cast("array<string>").alias("words"))

    def back(s, _):
        begin = F.get("best", s["at"])["start"]
        word = F.substring("run", begin, s["at"] - begin + 1)
        return F.when(s["at"] > 0, F.struct((begin - 1).alias("at"), F.array_append(s["words"], word).alias("words"))).otherwise(s)

    cut = paths.select("run", F.reverse(F.aggregate("lattice", start, back)["words"]).alias("words"))
    joined = runs.join(cut, "run", "left").select("key", "place", F.coalesce("words", F.array("run")).alias("words"))
    tokens = joined.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias("tokens"))
    return texts.select("key").join(tokens, "key", "left").select("key", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
