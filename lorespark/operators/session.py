"""The conversation state: windows over stored turns, and a state machine that takes one event after the other.

:func:`advance` is the machine's step; :func:`replay` runs it over stored events of each session, its
streaming twin is in ``lorespark.streaming``. An event is a turn (``user_input`` with what a parser
read from it), a reply to a question back (``clarify``, an empty ``ref`` refuses), or a note of what could
be gone on with (``working``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespark.functions.text import CONTINUE, INTERRUPT


def subjects(turns: DataFrame, interrupt: Column, subject: Column) -> DataFrame:
    """Current subject and the last three since the last interrupt, for each turn."""
    w = W.partitionBy("session_id").orderBy("turn_index")
    out = turns.withColumn("_stop", interrupt.cast("int")).withColumn("epoch", F.sum("_stop").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    e = W.partitionBy("session_id", "epoch").orderBy("turn_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.when(F.col("_stop") == 0, F.nullif(subject, F.lit("")))
    seen = F.collect_list(own).over(e)
    recent = F.slice(seen, F.greatest(F.size(seen) - 2, F.lit(1)), F.lit(3))
    return out.select("session_id", "turn_index", F.col("epoch").cast("bigint").alias("epoch"), F.last(own, ignorenulls=True).over(e).alias("current_subject"), F.array_join(recent, "|").alias("recent"))


def needs_clarification(intent: Column, subject: Column, current: Column) -> Column:
    """A gap: an intent without a subject, now or before."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return ~none(intent) & none(subject) & none(current) | none(intent)


PARSED = "intent string, subject string, audience string, constraint string"


def parsed(raw: Column) -> Column:
    """What a parser's reply says: the first flat ``{...}`` in it; intent and audience cut at 50 characters, subject at 100. ``valid`` if there is an intent."""
    j = F.from_json(F.regexp_extract(raw, r"\{[^{}]*\}", 0), PARSED)
    text = lambda name, n: F.left(F.coalesce(j[name], F.lit("")), F.lit(n))
    intent = text("intent", 50)
    return F.struct(intent.alias("intent"), text("subject", 100).alias("subject"), text("audience", 50).alias("audience"), F.coalesce(j["constraint"], F.lit("")).alias("constraint"), (intent != "").alias("valid"))


@dataclass(frozen=True)
class State:
    intent: str = ""
    subject: str = ""
    current: str = ""
    recent: str = ""  # the last three subjects, newline-joined
    goes_on: str = ""
    last_reply: str = ""  # to the last question back; empty if none was asked


@dataclass(frozen=True)
class Event:
    kind: str  # turn, clarify, working
    text: str = ""  # the input, the reference chosen, what can be gone on with
    intent: str = ""
    subject: str = ""


def built(intent: str, subject: str) -> str:
    if intent and subject:
        return intent if subject in intent else f"{subject} {intent}"
    return intent or subject


def expanded(state: State, subject: str, text: str) -> str:
    if state.goes_on and not subject:
        return state.goes_on
    query = built(state.intent, subject)
    return query if query and len(text) < len(query) else text


def advance(state: State, event: Event) -> tuple[State, str, str]:
    """The next state, the action (interrupted, retrieve, clarify, skip, noted) and the expanded question."""
    if event.kind == "working":
        return replace(state, goes_on=event.text), "noted", ""
    if event.kind == "clarify":
        answered = bool(state.last_reply)
        if event.text:
            state = replace(state, current=event.text, subject=event.text, last_reply=f"selected:{event.text}" if answered else "")
            return state, "retrieve", expanded(state, event.text, "")
        state = replace(state, last_reply="refused" if answered else "")
        return (state, "retrieve", expanded(state, state.current, "")) if state.current else (state, "skip", "")
    text = event.text.strip()
    if any(w in text for w in INTERRUPT):
        return State(), "interrupted", ""
    if state.goes_on and any(w in text for w in CONTINUE):
        return state, "retrieve", state.goes_on
    state = replace(state, intent=event.intent, subject=event.subject)
    if event.subject:
        recent = "\n".join([*filter(None, state.recent.split("\n")), event.subject][-3:])
        state = replace(state, current=event.subject, recent=recent)
    subject = event.subject or state.current
    if subject or state.last_reply == "refused":
        return state, "retrieve", expanded(state, subject, event.text)
    return replace(state, last_reply="pending"), "clarify", ""


FIELDS = ("intent", "subject", "current", "recent", "goes_on", "last_reply")
OUT = "session_id bigint, turn_index bigint, action string, expanded string, current_subject string, recent string"


def steps(session_id, state: State, rows: pd.DataFrame) -> tuple[State, pd.DataFrame]:
    """The machine over a session's events (turn_index, kind, text, intent, subject) in order."""
    rows = rows.sort_values("turn_index")
    out = []
    for turn, kind, *texts in rows[["turn_index", "kind", "text", "intent", "subject"]].itertuples(index=False):
        state, action, query = advance(state, Event(kind, *(x or "" for x in texts)))
        out.append((session_id, turn, action, query, state.current, state.recent.replace("\n", "|")))
    return state, pd.DataFrame(out, columns=["session_id", "turn_index", "action", "expanded", "current_subject", "recent"])


def replay(events: DataFrame) -> DataFrame:
    """Every event's action; a session's events are gathered, as each depends on the ones before."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return steps(key[0], State(), rows)[1]

    return events.groupBy("session_id").applyInPandas(run, OUT)


def snapshots(events: DataFrame) -> DataFrame:
    """``session_id`` and the fields of each session's state after its events, to be stored."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now = steps(key[0], State(), rows)[0]
        return pd.DataFrame([(key[0], *(getattr(now, f) for f in FIELDS))], columns=["session_id", *FIELDS])

    return events.groupBy("session_id").applyInPandas(run, "session_id bigint, " + ", ".join(f"{f} string" for f in FIELDS))


def in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs), ignore_index=True)
