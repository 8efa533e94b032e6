"""Jobs in batch: heartbeats, clean-up, digests, progress. folio.streaming has the live forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without a poll after which a running job is cancelled; minutes of the clean-up.
HEARTBEAT_SECONDS = 60
ABANDONED_MINUTES, ANALYZED_MINUTES, EMAIL_HOURS = 60, 5, 24
#: Seconds between two digests.
DIGEST_SECONDS = 3600


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("generating", "analyzed"))


def may_generate(status: Column) -> Column:
    return status == "analyzed"


def gaps(polls: DataFrame, key: str = "job_id", ts: str = "ts", seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """Polls after which the next one of the job came too late: key, ts, next_ts."""
    following = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    late = polls.select(key, ts, following.alias("next_ts")).where(F.col("next_ts").isNotNull())
    return late.where(F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) > seconds * 1_000_000)


def heartbeat_lost(now: Column) -> Column:
    """Whether a row of job states is to be cancelled."""
    return (F.col("status") == "generating") & ~F.col("email_registered") & (F.unix_timestamp(now) - F.unix_timestamp("last_poll") > HEARTBEAT_SECONDS)


def cleanup_action(now: Column) -> Column:
    """Says remove or keep for rows of job states, by the first rule that holds."""
    age = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)) / 60
    status = F.col("status")
    done = (
        F.when(F.col("email_registered") & F.col("email_sent_at").isNotNull(), age("email_sent_at") > EMAIL_HOURS * 60)
        .when(F.col("email_registered"), False)
        .when(age("completed_at") < ABANDONED_MINUTES, False)
        .when(F.col("downloaded_at").isNotNull(), age("downloaded_at") > ABANDONED_MINUTES)
        .otherwise(age("last_poll") > ABANDONED_MINUTES)
    )
    goes = (
        F.when(status == "cancelled", True)
        .when(F.col("email_registered") & status.isin("generating", "analyzed"), False)
        .when(status == "done", done)
        .when(status == "error", age("start_time") > ABANDONED_MINUTES)
        .when(status == "analyzed", age("last_poll") > ANALYZED_MINUTES)
        .otherwise(False)
    )
    return F.when(F.coalesce(goes, F.lit(False)), "remove").otherwise("keep")


def digests(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour") -> DataFrame:
    """Events of each hour and kind: window start, kind, n. Counts are made before the shuffle."""
    return events.groupBy(F.window(F.col(ts).cast("timestamp"), width)["start"].alias("start"), kind).agg(F.count("*").alias("n"))


def _throttle(seconds: int):
    """A function from key, at (microseconds), n, in order, to key, sent_at, events."""
    wait = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held, out = None, None, 0, []

        def sent(at):
            nonlocal last, held
            out.append((key, at, held))
            last, held = at, 0

        for batch in batches:
            for k, at, n in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "n"))):
                if held and (k != key or at > last + wait):
                    sent(last + wait)
                if k != key:
                    key, last = k, None
                held += n
                if last is None or at >= last + wait:
                    sent(at)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "at", "events"])
                out = []
        if held:
            sent(last + wait)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["key", "at", "events"])

    return run


def throttled(events: DataFrame, key: str = "job_id", ts: str = "ts", seconds: int = DIGEST_SECONDS) -> DataFrame:
    """(key, sent_at, events): the digests of each key. The first event is sent at once; what follows waits until `seconds` have
    passed since the last digest and is sent together, then or with the first event after. What comes at one time goes together.

    A key's digests depend on each other, so that one task goes through its times in order; it holds one digest at a time,
    and events of one time are counted before.
    """
    counted = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at is not null").groupBy("key", "at").agg(F.count("*").alias("n"))
    dealt = counted.repartition("key").sortWithinPartitions("key", "at")
    out = dealt.mapInArrow(_throttle(seconds), f"key {events.schema[key].dataType.simpleString()}, at bigint, events bigint")
    return out.select("key", F.timestamp_micros("at").alias("sent_at"), "events")


def with_snapshot(jobs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Jobs of both sides; where both have a column the live job's value counts."""
    both = [c for c in jobs.columns if c in tokens.columns and c != "job_id"]
    j, t = jobs.alias("j"), tokens.alias("t")
    met = j.join(t, F.col("j.job_id") == F.col("t.job_id"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"j.{c}"), F.col(f"t.{c}")).alias(c)
    own = [F.col(f"j.{c}") for c in jobs.columns if c not in (*both, "job_id")] + [F.col(f"t.{c}") for c in tokens.columns if c not in (*both, "job_id")]
    return met.select(pick("job_id"), *[pick(c) for c in both], *own)


def cancel_allowed(email_registered: Column, force: Column) -> Column:
    return ~F.coalesce(email_registered, F.lit(False)) | F.coalesce(force, F.lit(False))
