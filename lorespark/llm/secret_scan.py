"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Base spans come from three patterns (see ``BASE``). The method adds ``guess`` spans: a value
that follows a credential word and ``:``, ``=`` or ``is`` is cut into segments of least total
guesses by dynamic programming over its characters. A segment is a word (any case, digits for
letters), a date or year, a repeat of one character or of a block, a walk over neighbouring keys
or through the alphabet, or a run that has to be guessed by brute force. The value is a secret
if the least cost is at least ``min_log10`` guesses. Values that base spans already hold are
not added again.

Words are a short fixed list and the ``MAX_WORDS`` most frequent words of all documents (3 to 24
letters a-z, at least ``MIN_COUNT`` times), counted by Spark and broadcast as hashes with their
ranks. Words right after ``:``, ``=`` or a quote are not counted, so that a credential that many
copies of a text hold is no word.

The search has no bound on segments, runs or blocks but those that follow from the cost that is
asked about: segments whose number or whose block alone costs that much can't be part of a
cheaper cut. Where a value repeats a block of at most that size for over ``LONG`` characters,
or walks for that long, no cut is tried in the middle of it; its length counts whole.

Spans are in code points, the end exclusive, and cover the whole match (``guess``: the value).
A null text counts as empty. Repeated rows give repeated results; an empty table gives an empty
one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens as tk
from ._store import materialize, named
from .resample import _threshold

#: The base patterns, and the least length of what each has to hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "guess")

#: Credential words of the added spans; the value runs to white space, a quote or a bracket.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passwort|contraseña|mot\x20de\x20passe|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)"""
    r"""["']?\x20*(?:[:=]|\x20is\x20)\x20*(["']?)([^\s"'<>()\[\]{},;|]{6,})""",
    re.IGNORECASE,
)
_HINT = re.compile(r"pass|pwd|contras|secret|token|credential|key|auth", re.IGNORECASE)

#: Frequent words of passwords, most frequent first.
WORDS = (
    "password pass word admin user login root test guest default changeme welcome letmein hello love secret token key api "
    "access master dragon monkey shadow sunshine princess football baseball superman batman summer winter spring autumn "
    "monday friday january march april june july august october december qwerty abc example sample demo none null true false "
    "your here insert enter my the and of to in is for with that this from are was on as by an it or be"
).split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LEET = str.maketrans("4@831!0$57", "aabeiiosst")
#: The rows of a keyboard, and sequences.
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = {(a, b) for row in _ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])} | {
    (a, b) for x, y in zip(_ROWS[:3], _ROWS[1:4]) for p, q in zip(x[1:] if x[0] == "`" else x, y) for a, b in ((p, q), (q, p))
}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
MIN_LOG10 = 12.0
#: Words of the corpus that are broadcast at most, 16 bytes each.
MAX_WORDS = 50_000
MIN_COUNT = 3
_SHORTEST, _LONGEST = 3, 24
#: Characters of a repeat or walk up to which every cut is tried.
LONG = 1024
#: Characters of a value that are searched first; four times as many as long as some segmentation stays cheap to their end.
_FIRST = 256


@dataclass(frozen=True)
class Words:
    """Sorted hashes of words, and the rank of each."""

    hashes: np.ndarray
    ranks: np.ndarray

    def log_rank(self, hashed: np.ndarray) -> np.ndarray:
        """log10 of the guesses of words by hash; infinite for others."""
        if not len(self.hashes):
            return np.full(len(hashed), math.inf)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, np.log10(2.0 * self.ranks[at]), math.inf)


def ranked(words: list[str]) -> Words:
    """Words in the order of their ranks."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    hashed = tk.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
    by = np.argsort(hashed)
    return Words(hashed[by], by + 1)


COMMON = ranked(WORDS)


def _brute(s: str) -> float:
    """log10 of the characters that each of a run may be."""
    chars = set(s)
    kinds = (any(c.islower() for c in chars), any(c.isupper() for c in chars), any(c.isdigit() for c in chars), any(not c.isalnum() for c in chars))
    return math.log10(max(10, sum(n for n, k in zip((26, 26, 10, 33), kinds) if k)))


def _maximal(same: np.ndarray, step: int) -> np.ndarray:
    """For each place, the number of places from it on that are true without a break."""
    left = np.arange(len(same))
    stop = np.where(~same, left, len(same))
    return np.minimum.accumulate(stop[::-1])[::-1] - left if len(same) else left


def _shortened(s: str, longest: int) -> tuple[str, np.ndarray]:
    """The value without the middles of long repeats and walks, and the place of each character and of the end in it."""
    place = np.arange(len(s) + 1)
    for p in range(1, longest + 2):
        if len(s) <= 2 * LONG:
            break
        if p <= longest:
            code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
            same = code[p:] == code[:-p]
        else:  # walks last, as what repeats is short by now
            low = s.lower() if len(s.lower()) == len(s) else s
            same = np.array([x in _NEXT for x in zip(low, low[1:])])
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
        keep = np.ones(len(s), bool)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a > LONG:
                from_ = a + LONG // 2
                # whole blocks go, and a walk goes on at the same key, so that either goes on after the cut
                to = from_ + (b - a - LONG) // p * p if p <= longest else s.rfind(s[from_], from_, b - LONG // 2)
                keep[from_:to] = False
        s, place = "".join(c for c, k in zip(s, keep.tolist()) if k), np.append(place[:-1][keep], place[-1])
    return s, place


def guess_cost(value: str, enough: float = math.inf, words: Words = COMMON) -> float:
    """log10 of the guesses of the cheapest segmentation, or infinity if that is ``enough`` or more.

    A segmentation of k segments costs the product of their guesses times k!, as an attacker has
    to find the order too.
    """
    if not value:
        return 0.0
    if enough == math.inf:
        bound = 16.0
        while (cost := guess_cost(value, bound, words)) == math.inf:
            bound *= 2
        return cost
    # most long values cost enough within their first characters, whatever follows
    each = _brute(value)
    size = _FIRST
    while (cost := _cheapest(value[:size], size >= len(value), each, enough, words)) is None:
        size *= 4
    return cost


def _cheapest(value: str, whole: bool, each: float, enough: float, words: Words) -> float | None:
    """:func:`guess_cost` of a value, whose characters cost ``each``; of the beginning of one that isn't ``whole``: infinity if every
    segmentation costs enough before the end comes into reach, else None.
    """
    longest = int(enough / each) + 1  # a longer block alone costs enough
    s, place = _shortened(value, longest)
    n = len(s)
    most = n  # segments; the cheapest is a word of two guesses
    order = [0.0]  # log10 of k!
    while len(order) <= n:
        order.append(order[-1] + math.log10(len(order)))
        if order[-1] + (len(order) - 1) * math.log10(2) >= enough:
            most = len(order) - 1
            break
    order = np.array(order[: most + 1])
    low = s.lower() if len(s.lower()) == n else s
    forms = _word_ends(s, low, words)
    walk = _maximal(np.array([p in _NEXT for p in zip(low, low[1:])] + [False], bool), 1)
    code = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    repeat = [(p, _maximal(code[p:] == code[:-p], p)) for p in range(1, min(longest, n // 2) + 1)]
    # best[j][k]: the least cost of the first j characters in k segments; open_: with a brute-force run that may go on
    best = np.full((n + 1, most + 1), math.inf)
    best[0, 0] = 0.0
    open_ = np.full(most + 1, math.inf)
    last = 0

    def reach(ends: np.ndarray, cost: np.ndarray) -> None:
        nonlocal last
        if len(ends):
            found = here[None, :-1] + cost[:, None]
            best[ends, 1:] = np.minimum(best[ends, 1:], found)
            last = max(last, int(ends[-1]))

    for i in range(n):
        best[i] = np.minimum(best[i], open_)
        here = np.where(best[i] + order < enough, best[i], math.inf)
        open_ = np.where(open_ + order < enough, open_, math.inf)
        alive = bool(np.isfinite(here).any())
        if not alive and i >= last and not np.isfinite(open_).any():
            # no word or date from here on back reaches the end, nor did a walk or repeat
            return math.inf if whole or (i + _LONGEST < n and last < n) else None
        step = each * (place[i + 1] - place[i])
        open_ = np.minimum(open_, np.concatenate(([math.inf], here[:-1]))) + step
        if not alive:
            continue
        if i in forms:
            reach(*forms[i])
        if m := _DATE.match(s, i):
            reach(np.array([m.end()]), np.array([2.1 if m.end() - i == 4 else 4.6]))
        if walk[i] >= 2:
            ends = np.arange(i + 3, i + walk[i] + 2)
            reach(ends, np.log10(40.0 * (place[ends] - place[i])) + 0.4)
        periods: list[tuple[int, int]] = []
        for p, length in repeat:
            if i >= len(length) or length[i] < p or any(p % q == 0 and length[i] + p <= own + q for q, own in periods):
                continue
            periods.append((p, int(length[i])))
            ends = np.arange(i + 2 * p, i + length[i] + p + 1, p)
            ends = ends[ends - i >= 3]
            reach(ends, p * each + np.log10((place[ends] - place[i]) // p))
    if not whole:
        return None
    best[n] = np.minimum(best[n], open_)
    total = float((best[n] + order).min())
    return total if total < enough else math.inf


def _word_ends(s: str, low: str, words: Words) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By start: the ends of words in a value, and their costs."""
    starts, ends, costs = [], [], []
    length = np.arange(2, _LONGEST + 1)
    at = np.arange(len(s))
    a = np.repeat(at, len(length))
    b = a + np.tile(length, len(at))
    a, b = a[b <= len(s)], b[b <= len(s)]
    for form, extra in ((low, 0.0), (low.translate(_LEET), 0.3)):
        data = np.frombuffer(form.encode("ascii", "replace"), np.uint8)
        letter = np.concatenate(([0], np.cumsum((data >= 0x61) & (data <= 0x7A))))
        whole = letter[b] - letter[a] == b - a
        x, y = a[whole], b[whole]
        hashed = tk.span_hashes(data, x, y)
        cost = np.minimum(COMMON.log_rank(hashed), words.log_rank(hashed)) if words is not COMMON else COMMON.log_rank(hashed)
        known = np.isfinite(cost)
        starts.append(x[known])
        ends.append(y[known])
        costs.append(cost[known] + extra + np.array([0.3 if s[i:j] != low[i:j] else 0.0 for i, j in zip(x[known].tolist(), y[known].tolist())]))
    start, end, cost = map(np.concatenate, (starts, ends, costs))
    by = np.lexsort((-cost, end, start))  # of equal places the cheapest comes last
    start, end, cost = start[by], end[by], cost[by]
    final = np.ones(len(start), bool)
    final[:-1] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, cost = start[final], end[final], cost[final]
    return {i: (end[start == i], cost[start == i]) for i in np.unique(start).tolist()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


#: Runs of 24 or more; a shorter run fails as a whole, so that looking for long ones is the same.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def scan(text: str, min_log10: float = MIN_LOG10, words: Words = COMMON) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    added = []
    if _HINT.search(text):
        for m in CONTEXT.finditer(text):
            a, b = m.span(2)
            while b > a and text[b - 1] in ".:!?":
                b -= 1
            if b - a >= 6 and not any(s <= a and b <= e for s, _, e in base) and guess_cost(text[a:b], min_log10, words) >= min_log10:
                added.append((a, 3, b))
    return base, sorted(base + added)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: What a text has to hold to have a span at all; case folds as in the patterns, or wider.
_MAY = "(?i:pass|pwd|contras|secret|token|credential|key|auth)|AKIA|[0-9a-f]{24}"


def _scan(min_log10: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = pc.fill_null(pc.match_substring_regex(batch.column(1), _MAY), False)
            n = batch.num_rows
            counts: list[list[int]] = [[0] * n for _ in KINDS]
            base_text, all_text = [""] * n, [""] * n
            for i in np.flatnonzero(np.asarray(may)).tolist():
                base, every = scan(batch.column(1)[i].as_py(), min_log10, shared.value)
                for k in range(len(KINDS)):
                    counts[k][i] = sum(x[1] == k for x in every)
                base_text[i], all_text[i] = _named(base), _named(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_text, pa.string()), pa.array(all_text, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base", "spans"],
            )

    return run


_NO_LETTER = np.ones(256, bool)
_NO_LETTER[0x61:0x7B] = False
_QUOTES, _SIGNS = np.isin(np.arange(256), list(b"\"'")), np.isin(np.arange(256), list(b":="))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (hash of a word, how often)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate([c for _, c in held])).astype(np.int64)

    def flush():
        if held:
            key, count = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["word", "n"])

    for batch in batches:
        for _, _, data, offsets in tk.text_slices(batch.column(0)):
            lower = tk.LOWER[data]
            starts, ends, _ = tk.word_spans(lower, offsets, _NO_LETTER)
            one, two = lower[np.maximum(starts - 1, 0)], lower[np.maximum(starts - 2, 0)]
            fine = (ends - starts >= _SHORTEST) & (ends - starts <= _LONGEST) & ~_QUOTES[one] & ~_SIGNS[one] & ~((one == 0x20) & _SIGNS[two])
            key, count = np.unique(tk.span_hashes(lower, starts[fine], ends[fine]), return_counts=True)
            held.append((key, count))
            n += len(key)
            if n > 4_000_000:
                held = [merged()]
                n = len(held[0][0])
                if n > 2_000_000:
                    yield from flush()
                    held, n = [], 0
    yield from flush()


def corpus_words(texts: DataFrame, max_words: int = MAX_WORDS) -> Words:
    """The most frequent words of a column ``text``, after those of the fixed list; words of equal count at the end all or none."""
    counts = texts.select("text").mapInArrow(_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("key")).filter(F.col("key") >= MIN_COUNT)
    counts = materialize(counts, "words")
    least = MIN_COUNT if counts.count() <= max_words else _threshold(counts, max_words) + 1
    rows = counts.filter(F.col("key") >= least).toArrow()
    word, n = rows.column("word").to_numpy().view(np.uint64), rows.column("key").to_numpy()
    by = np.lexsort((word, -n))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) + len(WORDS) + 1
    order = np.argsort(word)
    return Words(word[order], rank[order])


def secret_scan(docs: DataFrame, min_log10: float = MIN_LOG10, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_guess, base, spans``; spans as kind:start:end, by start, comma-joined."""
    rows = docs.select(named(id_col).cast("bigint").alias("doc_id"), named(text_col).cast("string").alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(corpus_words(rows, max_words))
    return rows.mapInArrow(_scan(min_log10, words), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base string, spans string")
