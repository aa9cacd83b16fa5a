"""Streams of work events: repeated keys, windows with late data, sessions, holds with timers, routing by kind.

Every pipeline takes a streaming frame (id, org_id, kind, amount, at) and gives one; the sinks are the caller's. State is
bounded by watermarks. ``drained`` runs a pipeline over what is there and gives the result as a frame, for checks against
the batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = 100) -> DataFrame:
    """Events as they arrive as files below ``path``; None takes all files that are there in one batch.

    With a limit, files must come in time order within the delay of what follows, or their older events are late and go.
    """
    reader = spark.readStream.schema(EVENTS)
    raw = (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("org_id"), F.col("event_type").alias("kind"), F.col("value").cast("decimal(14,2)").alias("amount"), F.col("ts").cast("timestamp").alias("at"))


def once(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each idempotency key; keys are forgotten once the watermark has passed them."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def metered(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by organisation, kind and tumbling window; months are sums of days."""
    by = events.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), "org_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return by.select(F.col("w.start").alias("start"), "org_id", "kind", "n", "amount")


def sessions(events: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of an organisation's events without a gap."""
    by = events.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "org_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("org_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


FAILURES = "org_id long, longest long, disabled boolean"


def failure_runs(events: DataFrame, limit: int = 5) -> DataFrame:
    """(org_id, longest, disabled): the longest run of errors so far of each organisation, whenever it grows.

    Events are sorted within a batch; batches must come in time order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        before = longest
        for kind in rows["kind"]:
            run = run + 1 if kind == "error" else 0
            longest = max(longest, run)
        state.update((run, longest))
        if longest > before or not before:
            yield pd.DataFrame({"org_id": [key[0]], "longest": [longest], "disabled": [longest >= limit]})

    return events.groupBy("org_id").applyInPandasWithState(step, FAILURES, "run long, longest long", "update", GroupStateTimeout.NoTimeout)


HOLDS = "org_id long, id long, outcome string, ends timestamp"


def holds(events: DataFrame, minutes: int = 10, delay: str = "1 hour") -> DataFrame:
    """(org_id, id, outcome, ends): each event holds its organisation until the next one or until time is up.

    The last hold waits as state under an event-time timer; it expires when the watermark passes it.
    """
    span = pd.Timedelta(minutes=minutes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []

        def close(i: int, at: pd.Timestamp, until: pd.Timestamp | None) -> None:
            free = until is not None and until <= at + span
            out.append({"org_id": key[0], "id": i, "outcome": "released" if free else "expired", "ends": until if free else at + span})

        held = (state.get[0], pd.Timestamp(state.get[1], unit="us")) if state.exists else None
        if state.hasTimedOut:
            close(*held, None)
            state.remove()
        else:
            for i, at in pd.concat(list(frames)).sort_values(["at", "id"])[["id", "at"]].itertuples(index=False):
                if held:
                    close(*held, at)
                held = (int(i), at)
            state.update((held[0], held[1].value // 1000))
            state.setTimeoutTimestamp(max(int((held[1] + span).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["org_id", "id", "outcome", "ends"])

    return events.withWatermark("at", delay).groupBy("org_id").applyInPandasWithState(step, HOLDS, "id long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def routed(events: DataFrame, sinks: dict[str, str], checkpoint: str):
    """One stream to a table for each kind: a batch that is run again overwrites what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for kind, path in sinks.items():
            kept.where(F.col("kind") == kind).write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", keep: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into files below ``folder``, and reads them; ``keep`` reduces update rows to the last.
    A stream that was run under a ``name`` goes on from its checkpoint, and all that it gave is read."""
    path = f"{folder}/{name or uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}/out/batch=*")
    return keep(out) if keep else out
