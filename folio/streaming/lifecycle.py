"""Live jobs: states, heartbeats and clean-up as one stateful operator with timers.

Each job's state is what the batch rules of folio.operators.sessions read: status, times, e-mail. After every event the
operator knows when the next rule could fire and sets one timer for it; when that passes, the rules are asked
again at that time. A job that a rule removes leaves no state behind, and one without any event for KEEP_HOURS is
forgotten by the state's time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.sessions import ABANDONED_MINUTES, ANALYZED_MINUTES, DIGEST_SECONDS, EMAIL_HOURS, HEARTBEAT_SECONDS

#: Jobs that no rule removes are forgotten after so many hours without an event (processing time only).
KEEP_HOURS = 7 * 24
STATE = "status string, email boolean, start_time timestamp, last_poll timestamp, completed_at timestamp, downloaded_at timestamp, email_sent_at timestamp, timer bigint"
OUTPUT = "job_id string, ts timestamp, status string, reason string"
#: The status that an operation needs, and the one it leads to.
MOVES = {"ANALYZE": (None, "analyzed"), "GENERATE": ("analyzed", "generating"), "COMPLETE": ("generating", "done"), "FAIL": ("generating", "error")}


class Job(NamedTuple):
    """What is known of a job; times are naive UTC."""

    status: str | None = None
    email: bool = False
    start_time: datetime | None = None
    last_poll: datetime | None = None
    completed_at: datetime | None = None
    downloaded_at: datetime | None = None
    email_sent_at: datetime | None = None

    def after(self, operation: str, ts: datetime, force: bool = False) -> tuple[Job, str | None]:
        """The job after an event, and what changed (None: nothing to tell)."""
        seen = self._replace(last_poll=ts if self.last_poll is None else max(ts, self.last_poll), start_time=self.start_time or ts)
        before, to = MOVES.get(operation, ("", None))
        if to and before == self.status:
            return seen._replace(status=to, completed_at=ts if to == "done" else seen.completed_at), operation.lower()
        if operation == "CANCEL" and self.status in ("analyzed", "generating") and (force or not self.email):
            return seen._replace(status="cancelled"), "cancelled"
        if operation.startswith("DOWNLOAD"):
            return seen._replace(downloaded_at=self.downloaded_at or ts), None
        if operation in ("EMAIL_REGISTERED", "EMAIL_SENT"):
            return seen._replace(email=True, email_sent_at=ts if operation == "EMAIL_SENT" else seen.email_sent_at), None
        return seen, None

    def due(self) -> tuple[datetime, str] | None:
        """When a rule fires if nothing else happens, and which; None: never. The first rule that knows the job decides."""
        minutes = lambda t, n, reason: (t + timedelta(minutes=n), reason) if t else None
        if self.status == "cancelled":
            return self.last_poll, "cancelled"
        if self.email and self.status in ("generating", "analyzed"):
            return None
        if self.status == "generating":
            return (self.last_poll + timedelta(seconds=HEARTBEAT_SECONDS), "heartbeat") if self.last_poll else None
        if self.status == "done":
            if self.email:
                return minutes(self.email_sent_at, EMAIL_HOURS * 60, "email")
            held = minutes(self.downloaded_at, ABANDONED_MINUTES, "downloaded") or minutes(self.last_poll, ABANDONED_MINUTES, "abandoned")
            spared = minutes(self.completed_at, ABANDONED_MINUTES, "")
            return (max(held[0], spared[0]) if spared else held[0], held[1]) if held else None
        if self.status == "error":
            return minutes(self.start_time, ABANDONED_MINUTES, "error")
        if self.status == "analyzed":
            return minutes(self.last_poll, ANALYZED_MINUTES, "stale")
        return None

    def fired(self, now: datetime) -> tuple[Job | None, str] | None:
        """The job after the rule that has fired by now (None: it is removed), and the reason; None if none has."""
        due = self.due()
        if due is None or (now <= due[0] and self.status != "cancelled"):
            return None
        return (self._replace(status="cancelled"), due[1]) if due[1] == "heartbeat" else (None, due[1])


def _ms(ts: datetime) -> int:
    return int(ts.replace(tzinfo=timezone.utc).timestamp() * 1000)


def to_rocksdb(spark: SparkSession) -> None:
    """The state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class JobLifecycle(StatefulProcessor):
    """Rows of job_id, ts, operation, force to changes of state (job_id, ts, status, reason; status "removed" ends a job).

    event_time: rules follow the watermark, so that a replay of a log does what happened live; else the clock.
    """

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.event_time else KEEP_HOURS * 3600 * 1000
        self.state = handle.getValueState("job", STATE, ttl)

    def _held(self) -> tuple[Job, int | None]:
        held = self.state.get() if self.state.exists() else None
        return (Job(*(x.replace(tzinfo=None) if isinstance(x, datetime) else x for x in held[:7])), held[7]) if held else (Job(), None)

    def _keep(self, job: Job | None, timer: int | None) -> None:
        """Keeps the job and sets its timer for the moment after a rule's time."""
        due = job.due() if job else None
        then = _ms(due[0]) + 1 if due else None
        if timer is not None and timer != then:
            self.handle.deleteTimer(timer)
        if then is not None and timer != then:
            self.handle.registerTimer(then)
        if job is None:
            self.state.clear()
        else:
            self.state.update((*job, then))

    def _settle(self, key: str, job: Job | None, now: datetime, out: list) -> Job | None:
        """All rules that have fired by now, in turn."""
        at = datetime.min
        while job is not None and (fired := job.fired(now)):
            at = max(at, job.due()[0])  # a cancelled job goes when it is cancelled, not at its last poll
            job, reason = fired
            out.append((key, at, job.status if job else "removed", reason))
        return job

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, timer = self._held()
        out: list = []
        events = sorted(((r.ts.to_pydatetime(), r.operation, bool(r.force)) for batch in rows for r in batch.itertuples()), key=lambda e: e[0])
        for ts, operation, force in events:
            job = self._settle(key[0], job, ts, out)
            job, reason = (job or Job()).after(operation, ts, force)
            if reason:
                out.append((key[0], ts, job.status, reason))
        if job is not None and job.status is None:
            job = None  # nothing but polls of a job that isn't there
        self._keep(job, timer)
        yield pd.DataFrame(out, columns=["job_id", "ts", "status", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, _ = self._held()
        now = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).replace(tzinfo=None)
        out: list = []
        self._keep(self._settle(key[0], job, now, out), None)
        yield pd.DataFrame(out, columns=["job_id", "ts", "status", "reason"])

    def close(self) -> None:
        pass


def job_lifecycle(events: DataFrame, *, event_time: bool = True, delay: str = "1 minute") -> DataFrame:
    """Changes of state from a stream of (job_id, ts, operation, force), with heartbeats and clean-up.

    Operations: ANALYZE, GENERATE, COMPLETE, FAIL, CANCEL, DOWNLOAD..., EMAIL_REGISTERED, EMAIL_SENT; any other counts as a poll.
    A running job without e-mail that is silent for a minute is cancelled; cancelled, stale, downloaded, abandoned and
    expired jobs are removed.
    """
    to_rocksdb(events.sparkSession)
    force = F.col("force") if "force" in events.columns else F.lit(False)
    rows = events.select("job_id", "ts", "operation", F.coalesce(force, F.lit(False)).alias("force"))
    rows = rows.withWatermark("ts", delay) if event_time else rows
    return rows.groupBy("job_id").transformWithStateInPandas(JobLifecycle(event_time), OUTPUT, "Append", "EventTime" if event_time else "ProcessingTime")



DIGEST = "key string, sent_at timestamp, events bigint, payloads array<string>"


class Throttle(StatefulProcessor):
    """Rows of key, ts, payload to digests: what has come since the last one, no sooner than `seconds` after it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "sent_at timestamp, timer bigint")
        self.pending = handle.getListState("pending", "payload string")

    def _digest(self, key: str, at: datetime, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key, at, len(rows), rows)] if rows else [], columns=["key", "sent_at", "events", "payloads"])

    def _rest(self, last: datetime, timer: int | None, held: list) -> None:
        """Keeps what waits, with a timer for when it may go."""
        then = _ms(last + timedelta(seconds=self.seconds)) if held else None
        if timer is not None and timer != then:
            self.handle.deleteTimer(timer)
        if then is not None and timer != then:
            self.handle.registerTimer(then)
        self.sent.update((last, then))
        self.pending.put([(p,) for p in held]) if held else self.pending.clear()

    def _known(self) -> tuple[datetime | None, int | None, list]:
        last, timer = self.sent.get() if self.sent.exists() else (None, None)
        return last.replace(tzinfo=None) if last else None, timer, [p for (p,) in self.pending.get()] if self.pending.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, timer, held = self._known()
        events = sorted(((r.ts.to_pydatetime(), r.payload) for batch in rows for r in batch.itertuples()), key=lambda e: e[0])
        wait = timedelta(seconds=self.seconds)
        for i, (ts, payload) in enumerate(events):
            if held and last is not None and ts > last + wait:
                yield self._digest(key[0], last + wait, held)
                last, held = last + wait, []
            held.append(payload)
            more = i + 1 < len(events) and events[i + 1][0] == ts  # what comes at one time goes together
            if not more and (last is None or ts - last >= wait):
                yield self._digest(key[0], ts, held)
                last, held = ts, []
        if last is not None:
            self._rest(last, timer, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, held = self._known()
        at = last + timedelta(seconds=self.seconds)
        yield self._digest(key[0], at, held)
        self._rest(at, None, [])

    def close(self) -> None:
        pass


def throttled_digests(events: DataFrame, seconds: int = DIGEST_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Digests (key, sent_at, events, payloads) from a stream of (key, ts, payload): the first event goes at once, what follows
    waits until `seconds` have passed since the last digest and goes together, at that time or with the next event."""
    to_rocksdb(events.sparkSession)
    rows = events.select(F.col("key").cast("string").alias("key"), "ts", F.col("payload").cast("string").alias("payload")).withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(Throttle(seconds), DIGEST, "Append", "EventTime")
