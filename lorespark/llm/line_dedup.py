"""Line dedup with two Bloom filters.

A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased. Keys of at least ``min_chars`` code points that are found in at least
``min_docs`` documents lose all their lines except in the largest ``doc_id`` that
holds them. Steps:

1. One pass fills two Bloom filters: bits of keys seen once, and bits that a second
   document set again. Tasks send their set bits by segment of the filter and the
   segments are merged on the executors. Its size follows the number of keys up to
   ``MAX_BITS``, which bounds what is broadcast at any input size; a fuller filter only
   sends more lines on to step 2, so results stay exact.
2. Only lines whose bits are all in the twice-seen filter shuffle, as 128-bit hashes of
   their keys: they are grouped, counted by document and their largest id chosen. Counting
   is pre-aggregated on the map side, so a line that a third of all documents hold is no hot
   group. The choice comes back to the suspected lines by a join on the key; the keys of
   most documents, ``HOT_KEYS`` at most, are joined by broadcast, so that none is hot there.
3. Line numbers to drop come back by document.

Defined cases: a null text is one empty line, like an empty one. Every input row is a
document, repeated rows too; if several rows carry the largest id, all of them keep
the line. A null id ranks below all others. Columns besides the text pass through, whatever
their names; an empty table gives an empty one. A document's lines are gathered in its own
row, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom as bloom
from ._store import materialize, named, packed

#: Bits of each filter at most: 32 MB; the twice-seen one is broadcast. Over about 3.3 x 10^7
#: keys it gets fuller and lets more lines on to the exact step.
MAX_BITS = 1 << 28
#: Keys that are joined by broadcast at most, those of most documents (5 MB).
HOT_KEYS = 200_000
#: Documents of a key that is hot, at least.
HOT_DOCS = 500
_PROBES = 4
_STRIP = b" \t\n\x0b\x0c\r"


def _keys(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """Line number and key of each line whose key is long enough."""
    out = []
    for i, line in enumerate((text or "").encode().split(b"\n")):
        key = line.strip(_STRIP).lower()  # bytes.lower changes A-Z only
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            out.append((i, key))
    return out


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, by double hashing; ``bits`` is a power of two."""
    one, two = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (one[:, None] + np.arange(_PROBES, dtype=np.uint64) * two[:, None]) & np.uint64(bits - 1)


def _filter_parts(min_chars: int, bits: int):
    """Rows of (segment, bits set by one document, bits set by more), packed."""
    def flush(held: list[np.ndarray]):
        if not held:
            return
        # a key counts once for each document that has it, and a bit once for each key
        key, count = np.unique(np.concatenate(held), return_counts=True)
        places = _places(key, bits)
        places.sort(axis=1)
        fresh = np.ones(places.shape, bool)
        fresh[:, 1:] = places[:, 1:] != places[:, :-1]
        weight = np.minimum(count, 2)[:, None] * fresh
        once, times = np.unique(places[fresh], return_counts=True)
        total = np.zeros(len(once), np.int64)
        np.add.at(total, np.searchsorted(once, places[fresh]), weight[fresh])
        yield bloom.part(once, total > 1, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                keys = {xxhash.xxh3_64_intdigest(k) for _, k in _keys(text.as_py(), min_chars)}
                if keys:
                    held.append(np.fromiter(keys, np.uint64, len(keys)))
                    n += len(keys)
                if n > 1_000_000:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    return run


def _suspects(min_chars: int, bits: int, shared):
    """Rows of (document, key, its lines) for keys whose bits are all in the twice-seen filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            ids, marks, keys, lines = [], [], [], []
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own: dict[bytes, list[int]] = {}
                for i, key in _keys(text.as_py(), min_chars):
                    own.setdefault(key, []).append(i)
                if not own:
                    continue
                places = _places(np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)), bits)
                hit = bloom.test_bits(twice, places).all(axis=1)
                for (key, at), known in zip(own.items(), hit.tolist()):
                    if known:
                        ids.append(doc_id)
                        marks.append(mark)
                        keys.append(xxhash.xxh3_128_digest(key))
                        lines.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=["doc_id", "mark", "key", "lines"])

    return run


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with the kept text, then ``n_lines`` and ``n_dropped``.

    Input columns of those two names are replaced. ``min_docs`` is 2 at least.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    text = named(text_col).cast("string")
    base = docs.select(named(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    # a bound on the keys: lines that have min_chars bytes
    n = base.agg(F.sum(F.least(F.octet_length("text") / min_chars, F.size(F.split("text", "\n")).cast("double")))).first()[0] or 0
    bits = min(max_bits, max(1 << 16, bloom.power_of_two(int(n) * 8)))
    parts = base.select("text").mapInArrow(_filter_parts(min_chars, bits), bloom.PART_SCHEMA)
    shared = spark.sparkContext.broadcast(bloom.twice_seen(parts, bits))

    suspects = materialize(base.mapInArrow(_suspects(min_chars, bits, shared), "doc_id bigint, mark bigint, key binary, lines array<int>"), "line-suspects")
    found = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    found = materialize(found, "line-keys")
    # fewer than HOT_KEYS keys can have that many of all suspected lines
    hot = F.col("n") >= max(HOT_DOCS, suspects.count() // HOT_KEYS + 1)
    marked = suspects.join(F.broadcast(found.filter(hot).select("key", "keeper", F.lit(True).alias("hot"))), "key", "left")
    rest = marked.filter("hot IS NULL").drop("keeper", "hot").join(found.filter(~hot).select("key", "keeper"), "key")
    lost = marked.filter("hot").drop("hot").unionByName(rest).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # rows that are equal hold equal lists, which count once
    lost = lost.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lost"))
    lost = materialize(lost, "line-drops")

    rows = docs.select(
        packed(docs, ("n_lines", "n_dropped", text_col)).alias("row"), named(id_col).cast("bigint").alias("own_id"), F.xxhash64(text).alias("own_mark"), F.coalesce(text, F.lit("")).alias("text")
    )
    joined = rows.join(lost, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark")), "left")
    joined = joined.withColumn("lines", F.split("text", "\n"))  # a column, as inside a function over an array it would be split again each time
    lines = F.col("lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *(kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
