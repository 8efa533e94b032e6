"""Live jobs, digests, tokens and logs on small streams of files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folio.operators import sessions
from folio.sources import activity_stream
from folio.streaming import jobs, lifecycle

T0 = datetime(2026, 1, 1, 10)


def stream(spark, path, batches, schema):
    """A stream of one file for each batch of rows; columns of times are given as datetimes or text."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).selectExpr(*[f"cast({c} as timestamp) as {c}" if c in ("ts", "created_at") else c for c in names])
        df.coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    kind = spark.read.parquet(f"{path}/0").schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize(
    "steps, want",
    [(["ANALYZE", "GENERATE", "COMPLETE"], "done"), (["GENERATE"], None), (["ANALYZE", "EMAIL_REGISTERED", "CANCEL"], "analyzed"), (["ANALYZE", "CANCEL", "GENERATE"], "cancelled"), (["ANALYZE", "GENERATE", "FAIL"], "error"), (["ANALYZE", "GENERATE", "GENERATE", "POLL"], "generating")],
)
def test_moves(steps, want):
    job = lifecycle.Job()
    for i, s in enumerate(steps):
        job, _ = job.after(s, T0 + timedelta(seconds=i))
    assert job.status == want and job.last_poll == T0 + timedelta(seconds=len(steps) - 1)
    assert lifecycle.Job("analyzed", email=True).after("CANCEL", T0, force=True)[0].status == "cancelled"


EVENTS = "job_id string, ts timestamp, operation string, force boolean"


def test_lifecycle(spark, tmp_path):
    at = lambda m, s=0: T0 + timedelta(minutes=m, seconds=s)
    rows = [
        ("done", at(0), "ANALYZE"), ("done", at(0, 5), "GENERATE"), ("done", at(0, 50), "COMPLETE"), ("done", at(1), "DOWNLOAD"),
        ("silent", at(0), "ANALYZE"), ("silent", at(0, 5), "GENERATE"), ("silent", at(3), "POLL"),
        ("gone", at(0), "ANALYZE"), ("gone", at(0, 9), "CANCEL"), ("stale", at(0), "ANALYZE"), ("stale", at(4), "POLL"),
        ("mail", at(0), "ANALYZE"), ("mail", at(1), "EMAIL_REGISTERED"), ("mail", at(2), "GENERATE"), ("none", at(0), "POLL"),
    ]
    batches = [[(*r, False) for r in rows if r[1] < at(2)], [(*r, False) for r in rows if r[1] >= at(2)], [("clock", at(200), "POLL", False)], [("clock", at(201), "POLL", False)]]
    got = run(lifecycle.job_lifecycle(stream(spark, str(tmp_path / "in"), batches, EVENTS)), "lifecycle", tmp_path)
    by = {k: [(r.status, r.reason) for r in sorted(got, key=lambda r: (r.ts, r.status == "removed")) if r.job_id == k] for k in {r.job_id for r in got}}
    assert by == {
        "done": [("analyzed", "analyze"), ("generating", "generate"), ("done", "complete"), ("removed", "downloaded")],
        "silent": [("analyzed", "analyze"), ("generating", "generate"), ("cancelled", "heartbeat"), ("removed", "cancelled")],
        "gone": [("analyzed", "analyze"), ("cancelled", "cancelled"), ("removed", "cancelled")],
        "stale": [("analyzed", "analyze"), ("removed", "stale")],
        "mail": [("analyzed", "analyze"), ("generating", "generate")],
    }


def test_replay_equals_batch_rules(spark, tmp_path):
    """What the stream has removed or cancelled by some time is what the batch rules say of the same states."""
    rng, rows, states = random.Random(8), [], []
    now = T0 + timedelta(hours=30)
    for k in range(150):
        t, job, own = now - timedelta(minutes=rng.choice([1, 3, 4, 30, 59, 61, 70, 200, 1500, 1700])), lifecycle.Job(), []
        for op in ["ANALYZE", *rng.choice([[], ["GENERATE"], ["GENERATE", "FAIL"], ["GENERATE", "COMPLETE"], ["GENERATE", "COMPLETE", "DOWNLOAD"], ["CANCEL"], ["EMAIL_REGISTERED", "GENERATE"], ["EMAIL_REGISTERED", "GENERATE", "COMPLETE"], ["EMAIL_REGISTERED", "GENERATE", "COMPLETE", "EMAIL_SENT"]]), *["POLL"] * rng.randint(0, 2)]:
            own.append((f"j{k}", t, op, False))
            job, _ = job.after(op, t)
            t += timedelta(seconds=rng.randint(1, 5))
        rows += own
        states.append((f"j{k}", job.status, job.email, job.start_time, job.last_poll, job.completed_at, job.downloaded_at, job.email_sent_at))
    tick = [("clock", now + timedelta(minutes=1), "POLL", False)]  # the watermark is a minute behind
    rows.sort(key=lambda r: r[1])
    got = run(lifecycle.job_lifecycle(stream(spark, str(tmp_path / "in"), [rows[:300], rows[300:], tick, tick], EVENTS)), "replayed", tmp_path)
    kind = "job_id string, status string, email_registered boolean, start_time timestamp, last_poll timestamp, completed_at timestamp, downloaded_at timestamp, email_sent_at timestamp"
    moment = F.lit(now).cast("timestamp")
    batch = spark.createDataFrame(states, kind).select("job_id", "status", sessions.cleanup_action(moment).alias("action"), sessions.heartbeat_lost(moment).alias("lost")).collect()
    removed, lost = {r.job_id for r in got if r.status == "removed"}, {r.job_id for r in got if r.reason == "heartbeat"}
    assert {r.job_id for r in batch if r.lost} == lost and lost
    # a job that lost its heartbeat is cancelled, and cancelled jobs go
    assert {r.job_id for r in batch if r.action == "remove" or r.lost} == removed and 40 < len(removed) < 140


def test_throttled_digests(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((f"k{rng.randint(0, 3)}", T0 + timedelta(minutes=rng.choice([0, 1, 30, 60, 61, 119, 120, 200, 500]) + rng.randint(0, 2), seconds=rng.randint(0, 1)), str(i)) for i in range(80))
    rows.sort(key=lambda r: r[1])
    end = [("clock", T0 + timedelta(days=1), "x")]
    kind = "key string, ts timestamp, payload string"
    got = run(lifecycle.throttled_digests(stream(spark, str(tmp_path / "in"), [rows[:30], rows[30:], end, end], kind)), "throttled", tmp_path)
    batch = sessions.throttled(spark.createDataFrame(rows, kind), "key").collect()
    assert {(r.key, r.sent_at, r.events) for r in got if r.key != "clock"} == {(r.key, r.sent_at, r.events) for r in batch}
    assert sorted(p for r in got if r.key != "clock" for p in r.payloads) == sorted(r[2] for r in rows)
    by = {}
    for r in sorted(batch, key=lambda r: r.sent_at):
        assert r.key not in by or r.sent_at - by[r.key] >= timedelta(hours=1)
        by[r.key] = r.sent_at


def test_a_failed_send_is_repeated(spark, tmp_path):
    rows = stream(spark, str(tmp_path / "t"), [[("t1", "2026-01-01 10:00:00"), ("t2", "2026-01-01 10:05:00")]], "token string, created_at string")
    sent = []

    def send(df, n):
        sent.append((n, df.count()))
        if len(sent) == 1:
            raise RuntimeError("no post today")

    with pytest.raises(Exception, match="no post today"):
        jobs.send_digests(rows, send, str(tmp_path / "cp"), every=None).awaitTermination(60)
    jobs.send_digests(rows, send, str(tmp_path / "cp"), every=None).awaitTermination(60)
    assert sent == [(0, 2), (0, 2)]


def test_digest_tokens_and_progress(spark, tmp_path):
    rows = [("2026-01-01 10:01:00", "x"), ("2026-01-01 10:59:00", "y"), ("2026-01-01 11:30:00", "x"), ("2026-01-01 12:30:00", "x")]
    got = run(jobs.hourly_digest(stream(spark, str(tmp_path / "e"), [rows], "ts string, event_type string")), "digest", tmp_path)
    assert sorted((r.start.hour, r.n) for r in got) == [(10, 2), (11, 1)]
    tokens = stream(spark, str(tmp_path / "t"), [[("t1", "2026-01-01 10:00:00"), ("t1", "2026-01-01 10:05:00"), ("t2", "2026-01-01 10:06:00")]], "token string, created_at string")
    assert sorted(r.token for r in run(jobs.live_tokens(tokens), "tokens", tmp_path)) == ["t1", "t2"]
    polls = stream(spark, str(tmp_path / "p"), [[("a", "2026-01-01 10:00:00", 1), ("a", "2026-01-01 10:00:09", 4)]], "job_id string, ts string, done_chunks int")
    assert [r.done_chunks for r in run(jobs.progress(polls), "progress", tmp_path, "update")] == [4]


def test_snapshots_of_two_streams(spark, tmp_path):
    hour = lambda h: T0 + timedelta(hours=h)
    live = [("a", hour(0), "done"), ("b", hour(1), "error")]
    kept = [("a", hour(2), "kept", "audio"), ("c", hour(3), "kept", "podcast")]
    clock = hour(400)
    j = stream(spark, str(tmp_path / "j"), [live, [("x", clock, None)], [("x2", clock, None)]], "job_id string, ts timestamp, status string")
    t = stream(spark, str(tmp_path / "t"), [kept, [("y", clock, None, None)], [("y2", clock, None, None)]], "job_id string, created_at timestamp, status string, download_type string")
    got = [r for r in run(jobs.live_snapshots(j, t), "snapshots", tmp_path) if r.job_id in "abc"]
    batch = sessions.with_snapshot(spark.createDataFrame(live, "job_id string, ts timestamp, status string"), spark.createDataFrame(kept, "job_id string, created_at timestamp, status string, download_type string"))
    assert sorted(map(repr, got)) == sorted(map(repr, batch.select(*got[0].__fields__).collect())) and len(got) == 3


def test_token_table(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "token string, job_id string, created_at timestamp, download_type string, lang string, podcast_mp3s array<string>")
    path = str(tmp_path / "table")
    assert jobs.read_token_table(spark, path) is None
    jobs.upsert_tokens(rows(("t1", "j", T0, "audio", "en", ["a"]), ("t2", "j", T0, "audio", "en", None)), 0, path)
    second = rows(("t2", "k", T0 + timedelta(hours=2), "podcast", "it", ["x"]), ("t3", "j", T0 + timedelta(hours=1), "audio", "en", []))
    jobs.upsert_tokens(second, 1, path)
    held = lambda: sorted((r.token, r.job_id) for r in jobs.read_token_table(spark, path).collect())
    assert held() == [("t1", "j"), ("t2", "k"), ("t3", "j")]
    jobs.upsert_tokens(rows(("t9", "j", T0, "audio", "en", None)), 1, path)  # a batch that comes again
    assert held() == [("t1", "j"), ("t2", "k"), ("t3", "j")]
    (tmp_path / "table/v=7").mkdir()  # a version that was not finished
    jobs.upsert_tokens(rows(("t4", "j", T0 + timedelta(hours=26), "audio", "en", None)), 2, path)
    assert held() == [("t2", "k"), ("t4", "j")]
    feed = stream(spark, str(tmp_path / "in"), [[("t5", "j", T0, "audio", "en", None)], [("t6", "j", T0, "audio", "en", None)]], "token string, job_id string, created_at timestamp, download_type string, lang string, podcast_mp3s array<string>")
    jobs.token_table(feed, str(tmp_path / "live"), str(tmp_path / "cp"), every=None).awaitTermination(60)
    assert sorted(r.token for r in jobs.read_token_table(spark, str(tmp_path / "live")).collect()) == ["t5", "t6"]


@pytest.mark.parametrize("size", ["16777216", "50"])
def test_log_is_read_once(spark, tmp_path, size):
    line = lambda i, s: f's{i} # 2026-0{1 + i % 2}-03 04:05:{i % 60:02d} # "a "{s}" é.epub" # ANALYZE\n'
    logs = tmp_path / "logs"
    logs.mkdir()

    def read():
        q = activity_stream.stream_activity(spark, str(logs), range=size).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (logs / "activity_2026-01.log").write_text(line(0, "x") + "no line of the log\n" + line(2, "y") + line(4, "z")[:20], encoding="utf-8")
    assert read() == ["s0", "s2"]
    with open(logs / "activity_2026-01.log", "a", encoding="utf-8") as f:
        f.write(line(4, "z")[20:])
    (logs / "activity_2026-02.log").write_text("".join(line(i, "w") for i in (1, 3)), encoding="utf-8")
    assert read() == ["s0", "s1", "s2", "s3", "s4"] == read()
