"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct k-word shingles. Two documents link when
``den * |x & y| >= num * |x | y|``. Steps:

1. One pass hashes every text and groups rows with equal sets into classes, so
   exact copies are never compared.
2. A set that links with another one shares most of its shingles with it. A bit array of
   shingles that two classes may have (at most ``MAX_BITS`` bits, which bounds what is
   broadcast; chance hits only let more sets pass) leaves out the sets of which too few
   shingles are in it. Those have no links.
3. Blocks: sets that link differ in at most H shingles, a bound that follows from
   their sizes. All shingles are dealt by hash into more than H parts, so linked
   sets agree on a part. Each set sends a hash of each of its parts, for its own
   level of size and the next one; equal hashes give star edges to one class,
   never pairs. Equal hashes of a slice of text are merged before the shuffle, so a
   large group of near copies is no hot key. The connected components of these edges
   are the blocks in which all links lie. Unlike a shared rare shingle, a shared
   part is hardly ever chance, so blocks stay close to the groups of near copies.
4. Only classes in blocks have their sets gathered, once. Each block gets
   inverted lists; every set is a query against the sets before it by size:
   its longest lists are put aside, the short ones are heap-merged, and what
   occurs often enough there is probed in the long lists by binary search.
   A block whose estimated work is over ``TASK_WORK``, or that holds over ``BLOCK_TOKENS``
   shingles or ``WHOLE_SETS`` sets, is split into parts, and each pair of parts, a part with
   itself too, is a task of its own: nothing is capped. Smaller blocks are dealt to tasks by their work.

Result: one row per input row with ``doc_id``, ``n_shingles`` (set size),
``component_id`` (least id reachable by links) and ``n_links`` (documents
linked directly, copies included). Null, empty or wordless texts have an empty
set and link with nothing. Equal texts link with each other. Null ids are never
a component's id unless the component has no other. Rows that repeat an id are
documents of their own, and any number of rows may have a null id or the same one. An empty table gives an empty
one. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom as bloom
from . import _tokens as tk
from ._graph import connected_components
from ._store import arrow_rows, materialize, named

#: Shingles of a block, or of a part of one, that a task holds.
BLOCK_TOKENS = 2_000_000
#: Work over which a block is split, some 1 s: shingles times (``QUERY_WORK`` + sets of the block), see
#: :func:`link_block`. Every part of a split block goes to as many tasks as the block has parts, packed.
TASK_WORK = 100_000_000
QUERY_WORK = 200
#: Sets of a block that one task takes at most, and the least number of parts of a block that is split.
WHOLE_SETS, LEAST_PARTS = 500, 4
#: Work of the smaller blocks that are dealt to one task, on average.
BIN_WORK = 50_000_000
#: Partitions of the linking step at most; beyond that a partition takes several tasks in turn.
MAX_TASKS = 100_000
#: Bits of the array of shared shingles at most: 32 MB.
MAX_BITS = 1 << 28
#: Shingles and sets that a task of that array holds at a time.
HELD_TOKENS, HELD_SETS = 1_000_000, 200_000
#: Rows that go to a Python worker at a time: some 7 MB of text of usual length, on either side.
ARROW_ROWS = 2_000
#: DivideSkip's tuning factor: long lists L = T / (MU * log2(longest list) + 1).
MU = 0.0085


def needed(n, num: int, den: int):
    """The least overlap that a set of ``n`` can link with."""
    return -(-num * n // den)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of each row's shingles without repeats, and the rows' bounds in them."""
    lower = tk.LOWER[data]
    starts, ends, row = tk.word_spans(lower, offsets)
    at_row, token, _ = tk.shingles(tk.span_hashes(lower, starts, ends), row, k)
    n_rows = len(offsets) - 1
    tk.sort_within(at_row, token, n_rows)
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (at_row[1:] != at_row[:-1])
    return token[fresh], np.searchsorted(at_row[fresh], np.arange(n_rows + 1))


def fingerprints(token: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(tk.mix(token ^ np.uint64(salt)), out=total[1:])
        out.append(tk.mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _survey(k: int):
    """Rows of (id, set size, fingerprints, the columns after the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.text_slices(batch.column(1)):
                token, bounds = shingle_sets(data, offsets, k)
                one, two = fingerprints(token, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(one), pa.array(two), *(batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns))],
                    names=["doc_id", "n_shingles", "one", "two", *batch.schema.names[2:]],
                )

    return run


def levels(largest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each level, and of each level its number of parts and of spare parts.

    They go to the level after that of ``largest``, where sets of another slice may be; a level
    is the same whatever ``largest`` is. Sets that link are of one level or of two that follow each other. Those that meet at a
    level differ in less than ``parts - spare`` shingles, so that they agree on over ``spare``
    parts. No parts: sets meeting there link only if equal.
    """
    first = [1]
    while len(first) < 4 or first[-2] <= largest:
        first.append(max(first[-1] + 1, den * (first[-1] - 1) // num + 1))
    parts, spare = [], []
    for j in range(len(first) - 1):
        differ = (den - num) * 2 * (first[j + 1] - 1) // (den + num)
        least = first[max(0, j - 1)]
        extra = 1 + math.ceil(2 * differ * math.exp(-least / (differ + 1)))
        parts.append(differ + 1 + extra if differ else 0)
        spare.append(extra if differ else 0)
    return np.array(first[:-1]), np.array(parts), np.array(spare)


def signatures(token: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each part of each set, at its own level and the next.

    Empty parts are left out, unless a set has more of them than its level has spare parts: two
    sets that agree on over ``spare`` parts, one of them with ``spare`` empty ones at most,
    agree on one that isn't empty.
    """
    n = np.diff(bounds)
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, n_parts, n_spare = levels(int(n.max()), num, den)
    own = np.searchsorted(first, n, "right") - 1
    row = np.repeat(np.arange(len(n)), n)
    mixed, dealt = tk.mix(token ^ np.uint64(0x2545F4914F6CDD1D)), tk.mix(token + np.uint64(0x632BE59BD9B4E019))
    rows, out = [], []
    for step in (0, 1):
        level = own + step
        parts = np.where(n > 0, n_parts[level], 0)
        base = np.concatenate(([0], np.cumsum(parts)))
        has = parts[row] > 0
        part = (dealt[has] % np.maximum(parts[row[has]], 1).astype(np.uint64)).astype(np.int64)
        place = base[row[has]] + part
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, place, mixed[has])
        of = np.repeat(np.arange(len(n)), parts)
        number = np.arange(base[-1]) - base[of]
        full = np.zeros(base[-1], bool)
        full[place] = True
        empty = np.bincount(of[~full], minlength=len(n))
        send = full | (empty > n_spare[level])[of]
        salt = tk.mix((level[of].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        rows.append(of[send])
        out.append(tk.mix(total[send] + salt[send]))
    return np.concatenate(rows), np.concatenate(out)


def _slots(token: np.ndarray, bits: int) -> np.ndarray:
    return tk.mix(token ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(bits - 1)


def _shared(k: int, bits: int):
    """Parts of the array of shingles that two classes have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        known: set[int] = set()
        n = 0

        def flush():
            slot, count = np.unique(np.concatenate(held), return_counts=True)
            yield bloom.part(slot, count > 1, bits)

        for batch in batches:
            for _, _, data, offsets in tk.text_slices(batch.column(0)):
                token, bounds = shingle_sets(data, offsets, k)
                one, _ = fingerprints(token, bounds)
                new = np.zeros(len(one), bool)  # copies of a set are one class
                for i, x in enumerate(one.tolist()):
                    if x not in known:
                        known.add(x)
                        new[i] = True
                held.append(_slots(token[np.repeat(new, np.diff(bounds))], bits))
                n += len(held[-1])
                if len(known) > HELD_SETS:
                    known.clear()
                if n > HELD_TOKENS:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def _signatures(k: int, num: int, den: int, bits: int, array):
    """Rows of (signature, class), and of (any number, class, hub) for equal ones within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tk.text_slices(batch.column(0)):
                token, bounds = shingle_sets(data, offsets, k)
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n)), n)
                common = np.bincount(row[bloom.test_bits(array.value, _slots(token, bits))], minlength=len(n))
                may = common >= needed(n, num, den)
                token, n = token[may[row]], n[may]
                bounds = np.concatenate(([0], np.cumsum(n)))
                one, _ = fingerprints(token, bounds)
                row, sign = signatures(token, bounds, num, den)
                key, where, which = np.unique(sign, return_index=True, return_inverse=True)
                hub = one[row[where]]
                node, to = one[row], hub[which]
                other = node != to
                a, b = node[other], to[other]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((key.view(np.int64), a))), pa.array(np.concatenate((hub, a))), pa.array(np.concatenate((hub, b)), mask=np.arange(len(key) + len(a)) < len(key))],
                    names=["sign", "one", "hub"],
                )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each class of a signature to its first; the rows come sorted by signature."""
    last = None
    for batch in batches:
        sign, one = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        plain = np.asarray(batch.column(2).is_null())
        a, b = one[~plain], np.asarray(batch.column(2).drop_null())
        sign, one = sign[plain], one[plain]
        if len(sign):
            start = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
            hub = one[start].copy()
            if last is not None and last[0] == sign[0]:
                hub[0] = last[1]
            hub = np.repeat(hub, np.diff(np.concatenate((start, [len(sign)]))))
            last = (sign[-1], hub[-1])
            other = one != hub
            a, b = np.concatenate((a, one[other])), np.concatenate((b, hub[other]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(k: int):
    """Each candidate row's set, if its text is the one that its class stands for; of rows that repeat (id and text) a task gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            if given:
                batch = batch.filter(pa.array([c not in given for c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.bool_()))
            for a, b, data, offsets in tk.text_slices(batch.column(0)):
                token, bounds = shingle_sets(data, offsets, k)
                one, two = fingerprints(token, bounds)
                part = batch.slice(a, b - a)
                same = (np.asarray(part.column(1)) == one) & (np.asarray(part.column(2)) == two)
                raw = token.tobytes()
                blobs = [raw[8 * s : 8 * e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                out = pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(1, part.num_columns)), pa.array(blobs, pa.binary())],
                    names=[*part.schema.names[1:], "tokens"],
                )
                for i, c in enumerate(zip(out.column("one").to_pylist(), out.column("two").to_pylist())):
                    same[i] &= c not in given
                    if same[i]:
                        given.add(c)
                yield out.filter(pa.array(same))

    return run


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Records in at least ``least`` of the sorted lists, and in how many each is.

    The longest lists are set aside; the short ones are heap-merged (by one sort where they
    hold much), and records that may still reach ``least`` are searched in the long ones.
    """
    none = np.zeros(0, np.int64)
    if len(lists) < least:
        return none, none
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    if sum(map(len, short)) <= 256:
        found: list[int] = []
        times: list[int] = []
        for record in heapq.merge(*(x.tolist() for x in short)):
            if found and found[-1] == record:
                times[-1] += 1
            else:
                found.append(record)
                times.append(1)
        candidate, count = np.array(found, np.int64), np.array(times, np.int64)
    else:
        candidate, count = np.unique(np.concatenate(short), return_counts=True)
    for left, probed in zip(range(len(long), 0, -1), long):
        may = count + left >= least
        if not may.all():
            candidate, count = candidate[may], count[may]
        if not len(candidate):
            return none, none
        at = np.searchsorted(probed, candidate)
        count = count + (probed[np.minimum(at, len(probed) - 1)] == candidate)
    enough = count >= least
    return candidate[enough], count[enough]


def link_block(sets: list[np.ndarray], weight: np.ndarray, part: np.ndarray, num: int, den: int, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least-numbered record joined to each record, and the documents that each links with.

    ``across``: only records of different parts are compared. Every shingle of a set is looked up
    once (``QUERY_WORK``), and the records in its lists are as many as sets at most.
    """
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.arange(len(n)), n))
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    record = np.repeat(place, n)
    token = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    by = np.lexsort((record, token))
    token, record = token[by], record[by]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    end = np.concatenate((start[1:], [len(token)]))
    # occurrences that have an earlier record in their list, grouped by record
    head = np.repeat(start, end - start)
    later = np.flatnonzero(np.arange(len(token)) > head)
    later = later[np.argsort(record[later], kind="stable")]
    bounds = np.searchsorted(record[later], np.arange(len(n) + 1))
    size, part, weight = n[order], part[order], weight[order]
    root = list(range(len(n)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = np.zeros(len(n), np.int64)
    for q in range(len(n)):
        own = later[bounds[q] : bounds[q + 1]]
        least = needed(int(size[q]), num, den)
        if len(own) < least:
            continue
        found, count = divide_skip([record[head[i] : i] for i in own.tolist()], max(1, least))
        linked = den * count >= num * (size[q] + size[found] - count)
        if across:
            linked &= part[found] != part[q]
        found = found[linked]
        links[q] += weight[found].sum()
        links[found] += weight[q]
        for y in {find(x) for x in found.tolist()}:
            a, b = find(q), find(y)
            root[max(a, b)] = min(a, b)
    first = order[np.array([find(x) for x in range(len(n))], np.int64)] if len(n) else order
    return first[place], links[place]


_LINKED = "one bigint, two bigint, root bigint, links bigint"


def _link(num: int, den: int):
    """Links within each whole block of a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in pdf.groupby("block", sort=False):
            block = block.drop_duplicates(["one", "two"])
            sets = [np.frombuffer(t, np.uint64) for t in block["tokens"]]
            first, links = link_block(sets, block["weight"].to_numpy(), np.zeros(len(sets), np.int64), num, den)
            one = block["one"].to_numpy()
            out.append(pd.DataFrame({"one": one, "two": block["two"].to_numpy(), "root": one[first], "links": links}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("one", "two", "root", "links")})

    return run


def pack_part(one: np.ndarray, two: np.ndarray, weight: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """A part's classes and sets, small: near copies share most shingles, so each is written once and sets list their numbers as steps."""
    token, number = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    step = np.diff(number, prepend=0)
    step[np.cumsum(size) - size] = number[np.cumsum(size) - size]  # sets are sorted, and so are their numbers
    head = np.array([len(sets), len(token)], np.int64)
    return zlib.compress(b"".join(x.tobytes() for x in (head, one, two, weight, size, token, step.astype(np.uint32))), 1)


def unpack_part(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    raw = zlib.decompress(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    one, two, weight, size = np.frombuffer(raw, np.int64, 4 * n, 16).reshape(4, n)
    token = np.frombuffer(raw, np.uint64, m, 16 + 32 * n)
    step = np.frombuffer(raw, np.uint32, offset=16 + 32 * n + 8 * m).astype(np.int64)
    ends = np.cumsum(size)
    return one, two, weight, [token[np.cumsum(step[a:b])] for a, b in zip((ends - size).tolist(), ends.tolist())]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates(["one", "two"])
    blob = pack_part(pdf["one"].to_numpy(), pdf["two"].to_numpy(), pdf["weight"].to_numpy(), [np.frombuffer(t, np.uint64) for t in pdf["tokens"]])
    return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "part": pdf["part"].iloc[:1].to_numpy(), "parts": pdf["parts"].iloc[:1].to_numpy(), "sets": [blob]})


def _link_parts(num: int, den: int):
    """Links within a part, or across two parts; a part without sets has no row and gives no links."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("part")
        across = bool(key[1] != key[2])
        got = [unpack_part(x) for x in pdf["sets"]]
        one, two, weight = (np.concatenate([g[i] for g in got]) for i in range(3))
        part = np.repeat(pdf["part"].to_numpy(), [len(g[0]) for g in got])
        first, links = link_block([s for g in got for s in g[3]], weight, part, num, den, across)
        return pd.DataFrame({"one": one, "two": two, "root": one[first], "links": links})

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See the module's text. ``num / den`` is the least Jaccard similarity of a link."""
    return ngram_groups(docs, k, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id", "n_links")


def ngram_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """The join's rows with the columns ``keys`` of the input, of bigint, and ``group``.

    ``group`` is the same for linked rows only, also where ids are null or repeated; null for an empty set.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):  # every step with Python is written before this ends
        return _groups(docs, k, num, den, id_col, text_col, keys)


def _groups(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, keys: tuple[str, ...]) -> DataFrame:
    docs = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("string").alias("text"), *keys).withColumn("digest", F.xxhash64("text"))
    rows = docs.select("doc_id", "text", "digest", *keys).mapInArrow(_survey(k), ", ".join(["doc_id bigint, n_shingles bigint, one bigint, two bigint, digest bigint", *(f"{c} bigint" for c in keys)]))
    rows = materialize(rows, "join-survey")
    docs = docs.select("doc_id", "text", "digest")
    # a class stands for the text of its row of least id; ids may be null or repeated, so a row is known by id and text
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    classes = rows.filter("n_shingles > 0").groupBy("one", "two").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.count("*").alias("weight"))
    classes = materialize(classes.select("one", "two", F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("rep_digest"), "n", "weight"), "join-classes")

    bits = min(MAX_BITS, max(1 << 16, bloom.power_of_two(2 * (classes.agg(F.sum("n")).first()[0] or 0))))
    array = bloom.twice_seen(docs.select("text").mapInArrow(_shared(k, bits), bloom.PART_SCHEMA), bits)
    array = docs.sparkSession.sparkContext.broadcast(array)
    signed = docs.select("text").mapInArrow(_signatures(k, num, den, bits, array), "sign bigint, one bigint, hub bigint")
    edges = signed.repartition("sign").sortWithinPartitions("sign").mapInArrow(_stars, "a bigint, b bigint")
    blocks = connected_components(edges).select(F.col("node").alias("one"), F.col("label").alias("block"))

    candidates = materialize(classes.join(blocks, "one").select("rep", "rep_digest", "one", "two", "weight", "block", "n"), "join-candidates")
    sizes = candidates.groupBy("block").agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("members"))
    work = F.col("total") * (QUERY_WORK + F.col("members"))
    # a pair of parts holds 2 / parts of the shingles and of the sets
    parts = F.when((work <= TASK_WORK) & (F.col("total") <= BLOCK_TOKENS) & (F.col("members") <= WHOLE_SETS), 1).otherwise(
        F.greatest(F.ceil(2 * F.sqrt(work / TASK_WORK)), F.ceil(2 * F.col("total") / BLOCK_TOKENS), F.lit(LEAST_PARTS))
    ).cast("int")
    sizes = materialize(sizes.select("block", parts.alias("parts"), "total", "members", work.alias("work")), "join-blocks")
    alone = F.col("parts") == 1
    largest, all_work, all_tokens, all_sets, n_pairs = sizes.agg(
        F.max("parts"), *(F.sum(F.when(alone, F.col(c))) for c in ("work", "total", "members")), F.sum(F.when(~alone, F.col("parts") * (F.col("parts") + 1) / 2))
    ).first()
    bins = max(1, math.ceil((all_work or 0) / BIN_WORK), math.ceil((all_tokens or 0) / (BLOCK_TOKENS / 2)), math.ceil((all_sets or 0) / WHOLE_SETS))
    candidates = candidates.join(sizes.select("block", "parts"), "block")
    sets = (
        docs.join(candidates.hint("merge"), (docs["digest"] == candidates["rep_digest"]) & docs["doc_id"].eqNullSafe(candidates["rep"])).select("text", "one", "two", "weight", "block", "parts")
        .mapInArrow(_sets(k), "one bigint, two bigint, weight bigint, block bigint, parts int, tokens binary")
    )
    if (largest or 0) > 1:  # two branches read them
        sets = materialize(sets, "join-sets")
    whole = sets.filter("parts = 1").select("one", "two", "weight", "block", "tokens", F.pmod(F.hash("block"), F.lit(bins)).alias("task"))
    linked = whole.repartition(min(bins, MAX_TASKS), "task").groupBy("task").applyInPandas(_link(num, den), _LINKED)
    if (largest or 0) > 1:
        parted = sets.filter("parts > 1").withColumn("part", F.pmod(F.hash("one"), F.col("parts")))
        packed = parted.groupBy("block", "part").applyInPandas(_pack, "block bigint, part int, parts int, sets binary")
        pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pairs = pairs.select("block", "part", "sets", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        pairs = pairs.repartition(min(int(n_pairs), MAX_TASKS), "block", "i", "j").groupBy("block", "i", "j")
        linked = linked.unionByName(pairs.applyInPandas(_link_parts(num, den), _LINKED))
    linked = materialize(linked, "join-links")
    if (largest or 0) > 1:
        again = connected_components(linked.filter("one != root").select(F.col("one").alias("a"), F.col("root").alias("b")))
        linked = linked.join(again.withColumnRenamed("node", "one"), "one", "left").withColumn("root", F.coalesce("label", "one"))
    joined = linked.groupBy("one", "two").agg(F.min("root").alias("root"), F.sum("links").alias("links"))
    joined = joined.join(classes.select("one", "two", "rep"), ["one", "two"])
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    joined = joined.join(least, "root").select("one", "two", "links", "least", "root")
    out = rows.join(classes.select("one", "two", "rep", "weight"), ["one", "two"], "left").join(joined, ["one", "two"], "left")
    return out.select(
        "doc_id", "n_shingles",
        F.coalesce("least", "rep", "doc_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("bigint").alias("n_links"),
        *keys, F.when(F.col("n_shingles") > 0, F.coalesce("root", "one")).alias("group"),
    )
