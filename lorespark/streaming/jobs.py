"""Structured Streaming jobs: exactly-once co-occurrence counts, gap events, event-time windows, session state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators import session


def first_sights(traces: DataFrame, watermark: str | None = None) -> DataFrame:
    """The first trace of each (question, point). Without a watermark the keys are kept for ever, as the batch twin does."""
    keys = ["question_hash", "point_id"]
    if watermark:
        return traces.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(keys)
    return traces.dropDuplicates(keys)


def cooccurrence_counts(traces: DataFrame) -> DataFrame:
    return first_sights(traces).groupBy("question_terms", "point_id").agg(F.count("*").alias("hit_count"), F.count_if(F.col("quality") == "confident").alias("confident_count"))


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """All that has arrived, in micro-batches; ``write`` has to give the same result if a batch comes again."""
    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Bounded by files per batch, so that nothing is dropped when the source is ahead."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed(events: DataFrame, length: str, late: str) -> DataFrame:
    """Counts by event-time window and type; events later than ``late`` are left out (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def session_state(turns: DataFrame) -> DataFrame:
    """Turn count and current subject of each session after each micro-batch, kept as keyed state.

    ``turns``: session_id, turn_index, subject (empty: none), interrupt.
    """

    def step(key, batches, state: GroupState):
        subject, n = state.get if state.exists else ("", 0)
        for pdf in batches:
            rows = pdf.sort_values("turn_index")
            n += len(rows)
            # what counts is the last subject after the last interrupt
            stops = rows["interrupt"].to_numpy().nonzero()[0]
            after = rows["subject"].iloc[stops[-1] + 1 :] if len(stops) else rows["subject"]
            named = after[after.fillna("") != ""]
            subject = named.iloc[-1] if len(named) else "" if len(stops) else subject
        state.update((subject, n))
        yield pd.DataFrame({"session_id": [key[0]], "subject": [subject], "turns": [n]})

    return turns.groupBy("session_id").applyInPandasWithState(step, "session_id bigint, subject string, turns bigint", "subject string, turns bigint", "update", GroupStateTimeout.NoTimeout)


_KEPT = ", ".join(f"{f} string" for f in session.FIELDS)


class _Machine(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", _KEPT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.kept.update(tuple(initialState[f].iloc[0] or "" for f in session.FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = session.in_order(rows)
        now = session.State(*self.kept.get()) if self.kept.exists() else session.State()
        now, out = session.steps(key[0], now, events)
        self.kept.update(tuple(getattr(now, f) for f in session.FIELDS))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(int(events["at"].max().timestamp() * 1000) + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None: ...


def session_machine(events: DataFrame, snapshots: DataFrame | None = None, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """The state machine of :mod:`lorespark.operators.session` over a stream of events, its state kept by session.

    A micro-batch's events of a session are taken in the order of their turns. ``snapshots`` (session_id and the state's fields, as
    :func:`session.snapshots` gives them) are the states that sessions begin with. With ``idle_ms`` a session's state goes
    once the watermark, ``late`` behind the latest event's ``at``, is so much past its last event; it begins anew if it comes back.
    """
    # state with timers and initial values needs this store
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if idle_ms is not None:
        events = events.withWatermark("at", late)
    initial = snapshots.select("session_id", *session.FIELDS).groupBy("session_id") if snapshots is not None else None
    return events.groupBy("session_id").transformWithStateInPandas(_Machine(idle_ms), session.OUT, "append", "none" if idle_ms is None else "eventTime", initialState=initial)


def table_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its own, so that one that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All that a :func:`table_writer` has written."""
    return spark.read.schema(schema).parquet(path).drop("batch")


Handler = Callable[[DataFrame], DataFrame]


def handle_tasks(tasks: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """``task_id, task_type, status, error`` of tasks (task_id, task_type, payload), by the handler of their type.

    A handler gives ``task_id, error`` (null: done) for its tasks; types without one fail. A task whose
    payload breaks a handler's rule fails alone. Nothing is dropped: a stream takes more when it is ready.
    """
    out = tasks.filter(~F.col("task_type").isin(list(handlers)) | F.col("task_type").isNull()).select("task_id", "task_type", F.lit("no handler").alias("error"))
    for kind, handler in handlers.items():
        own = tasks.filter(F.col("task_type") == kind)
        out = out.unionByName(handler(own).select("task_id", F.lit(kind).alias("task_type"), "error"))
    return out.select("task_id", "task_type", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error")


def gap_writer(path: str, known: DataFrame, threshold: int) -> Callable[[DataFrame, int], None]:
    """Adds each micro-batch's gap events to the counts of the batch before, and marks the events.

    The counts after batch n are a table of their own, made from those after n - 1: a batch that comes
    again gives the same table, so an event counts once however often its batch is run.
    """
    from lorespark.operators.trace import gap_counts

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/gaps/after={number - 1}") if number else spark.createDataFrame([], "question_terms string, hit_count bigint, question string")
        after = gap_counts(before.select("question_terms", "hit_count", "question"), batch, known, threshold)
        after.write.mode("overwrite").parquet(f"{path}/gaps/after={number}")
        batch.select("event_id").write.mode("overwrite").parquet(f"{path}/processed/batch={number}")

    return write


def observed(df: DataFrame, stage: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a plan node named ``stage`` that counts the rows which pass it in each micro-batch, as ``rows``.

    ``keys``: conditions as ``name=SQL``, such as one for each source, whose rows are counted too.
    """
    return df.observe(stage, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.expr(k.split("=", 1)[1])).alias(k.split("=", 1)[0]) for k in keys))


class Progress(StreamingQueryListener):
    """Collects what a query reports of its micro-batches; a listener never holds a query up.

    ``stages`` adds up the counts of :func:`observed` by stage and name. A batch that is reported again counts once.
    """

    def __init__(self):
        self.rows: list[tuple[int, int]] = []
        self.counted: dict[tuple[str, int, str, str], int] = {}
        self.ended = False

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((p.batchId, p.numInputRows))
        for stage, row in p.observedMetrics.items():
            for name, n in row.asDict().items():
                self.counted[str(p.id), p.batchId, stage, name] = n

    def stages(self) -> dict[tuple[str, str], int]:
        out: dict[tuple[str, str], int] = {}
        for (_, _, stage, name), n in self.counted.items():
            out[stage, name] = out.get((stage, name), 0) + n
        return out

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.ended = True


def every(spark: SparkSession, job: Callable[[int], None], interval: str, checkpoint: str, first_after: float = 0.0) -> StreamingQuery:
    """Runs ``job`` with the run's number at each tick until the query is stopped, the first time ``first_after`` seconds from now."""
    import time

    begun = time.monotonic()

    def write(batch: DataFrame, number: int) -> None:
        if time.monotonic() - begun >= first_after:
            job(number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
