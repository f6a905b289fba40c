"""Quality classifier by importance resampling.

The n-grams of a text are its words (A-Z lower-cased), its words' shapes (runs of letters, digits
and capitals as one character each, all else as it is) and the pairs of adjacent ones of either
kind, hashed into ``BUCKETS`` buckets. Two generative models are counted, by documents that have
an n-gram: of all documents, and of target documents, those that ``labels`` calls good and not
toxic. A document's log weight is the sum over its n-grams of the log ratio of the two, both
without the document itself, so that a text doesn't vouch for or against its own n-grams; one that
it has t times counts 1 + ln t. The log of (g + ``SMOOTHING``) / (e + ``SMOOTHING``), where g target
documents have the n-gram and e are expected, is shrunk by z^4 / (z^4 + ``SHRINK``^4), z being
|g - e| / sqrt(e + 1): what chance explains says nothing, however many rare n-grams a text has.

Adding Gumbel noise, a function of seed, id and text, and taking the top k samples k documents
without replacement in proportion to their weights. k is ``share`` of the documents; without it, as
many that ``keep`` of the target documents are among them, all documents if there are no targets.

The target model is fitted on the ``MAX_TARGET`` target ids of least hash at most, a documented
bound on what is broadcast; all other counts cover all documents. The threshold for the top k is
found by counting keys by their leading bits, 16 at a time, so nothing is sorted or gathered.

One row per input row: ``doc_id, mark, n_grams, log_weight, noisy_weight, selected``. Null and
empty texts have weight 0 before noise. Rows with equal keys (repeated rows) are selected
together. Without target documents all ratios are 0. Other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as tk
from ._store import least_hashed, materialize, named

BUCKETS = 1 << 20
MAX_TARGET = 20_000
SMOOTHING = 0.5
SHRINK = 4.0


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("a"), ord("A"), ord("0")]] = True


def _pairs(row: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = row[:-1] == row[1:]
    return row[:-1][same], tk.mix(hashed[:-1][same] * np.uint64(3) + hashed[1:][same] * np.uint64(0x9E3779B97F4A7C15))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and number of each different n-gram of each row."""
    lower = tk.LOWER[data]
    starts, ends, row = tk.word_spans(lower, offsets)
    words = tk.span_hashes(lower, starts, ends)
    shape = _SHAPE[data]
    kept = np.ones(len(shape), bool)
    kept[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[shape[1:]]
    kept[starts] = True
    place = np.concatenate(([0], np.cumsum(kept)))
    shapes = tk.mix(tk.span_hashes(shape[kept], place[starts], place[ends]) + np.uint64(0x632BE59BD9B4E019))
    parts = [(row, words), _pairs(row, words), (row, shapes), _pairs(row, shapes)]
    key = np.concatenate([r for r, _ in parts]) * BUCKETS + (np.concatenate([h for _, h in parts]) & np.uint64(BUCKETS - 1)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, times


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and target documents by bucket; those of all buckets stand under ``BUCKETS``."""
    raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        flag = np.asarray(batch.column(1).fill_null(False))
        raw[BUCKETS] += len(flag)
        target[BUCKETS] += flag.sum()
        for a, b, data, offsets in tk.text_slices(batch.column(0)):
            row, bucket, _ = _hashed(data, offsets)
            raw[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
            target[:BUCKETS] += np.bincount(bucket[flag[a:b][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def log_ratio(raw: np.ndarray, good: np.ndarray, n_docs, n_target) -> np.ndarray:
    """The shrunk log ratio of n-grams that ``raw`` of ``n_docs`` and ``good`` of ``n_target`` documents have."""
    expected = raw * (n_target / np.maximum(n_docs, 1))
    z = (good - expected) ** 4 / (expected + 1) ** 2
    return np.log((good + SMOOTHING) / (expected + SMOOTHING)) * (z / (z + SHRINK**4))


#: Buckets of a packed row.
_PACK = 1 << 13


def _pack(key, rows):
    raw, target = np.zeros(_PACK, np.int64), np.zeros(_PACK, np.int64)
    at = np.asarray(rows.column("bucket")) % _PACK
    raw[at], target[at] = np.asarray(rows.column("raw")), np.asarray(rows.column("target"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "raw": pa.array([raw.tobytes()]), "target": pa.array([target.tobytes()])})


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good, n_docs, n_target = shared.value
        for batch in batches:
            uniform = np.asarray(batch.column(2))
            flag = np.asarray(batch.column(3).fill_null(False)).astype(np.int64)
            for a, b, data, offsets in tk.text_slices(batch.column(4)):
                row, bucket, times = _hashed(data, offsets)
                own = flag[a:b][row]
                ratio = log_ratio(raw[bucket] - 1.0, good[bucket] - own, n_docs - 1.0, n_target - own) if n_target else np.zeros(len(row))
                weight = np.bincount(row, ratio * (1 + np.log(times)), minlength=b - a)
                noisy = weight - np.log(-np.log(uniform[a:b])) + 0.0
                bits = noisy.view(np.int64)
                key = np.where(bits < 0, ~(bits & 0x7FFFFFFFFFFFFFFF), bits)  # orders like the number
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.bincount(row, times, minlength=b - a).astype(np.int64)), pa.array(weight), pa.array(noisy), pa.array(key), pa.array(flag[a:b] > 0)],
                    names=["doc_id", "mark", "n_grams", "log_weight", "noisy_weight", "key", "is_target"],
                )

    return run


def _threshold(keys: DataFrame, k: int) -> int:
    """The greatest key that at least ``k`` keys reach, from counts by 16 bits at a time."""
    low, shift = -(1 << 63), 48
    while True:
        within = keys.filter(F.col("key") >= low) if shift == 48 else keys.filter((F.col("key") >= low) & (F.col("key") <= low + (1 << (shift + 16)) - 1))
        counts = within.groupBy(F.shiftright("key", shift).alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect()
        for r in counts:
            if r["n"] >= k:
                low = r["b"] << shift
                break
            k -= r["n"]
        if not shift:
            return low
        shift -= 16


def target_sample(labels: DataFrame, max_target: int = MAX_TARGET, seed: int = 23) -> DataFrame:
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("target_id")).distinct()
    return least_hashed(good.withColumn("o", F.xxhash64(F.lit(seed), "target_id")), "o", max_target, good.count(), "target_id").select("target_id")


def importance_resample(docs: DataFrame, labels: DataFrame, share: float | None = None, keep: float = 0.995, max_target: int = MAX_TARGET, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = named(text_col).cast("string")
    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    target = materialize(target_sample(labels, max_target, seed).withColumn("is_target", F.lit(True)), "target")
    flagged = rows.join(F.broadcast(target), rows["doc_id"] == target["target_id"], "left")
    counts = flagged.select("text", "is_target").mapInArrow(_count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, good = np.zeros(BUCKETS + _PACK), np.zeros(BUCKETS + _PACK)
    # packed, so that the driver gets 16 bytes a bucket and no rows
    for r in counts.groupBy(F.floor(F.col("bucket") / _PACK).alias("part")).applyInArrow(_pack, "part bigint, raw binary, target binary").toLocalIterator():
        at = slice(r["part"] * _PACK, (r["part"] + 1) * _PACK)
        raw[at], good[at] = np.frombuffer(r["raw"], np.int64), np.frombuffer(r["target"], np.int64)
    n, n_target = int(raw[BUCKETS]), int(good[BUCKETS])
    model = docs.sparkSession.sparkContext.broadcast((raw[:BUCKETS].astype(np.float32), good[:BUCKETS].astype(np.float32), n, n_target))
    noise = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("gumbel"), "doc_id", "mark"), 11).cast("double") + 0.5) / float(1 << 53)
    schema = "doc_id bigint, mark bigint, n_grams bigint, log_weight double, noisy_weight double, key bigint, is_target boolean"
    scores = materialize(flagged.select("doc_id", "mark", noise.alias("u"), "is_target", "text").mapInArrow(_weigh(model), schema), "weights")
    if share is not None:
        k = min(n, max(0, round(float(share) * n)))
        reached = F.col("key") >= _threshold(scores, k) if k else F.lit(False)
    elif n_target:
        reached = F.col("key") >= _threshold(scores.filter("is_target"), max(1, math.ceil(keep * n_target)))
    else:
        reached = F.lit(True)
    return scores.select("doc_id", "mark", "n_grams", "log_weight", "noisy_weight", reached.alias("selected"))
