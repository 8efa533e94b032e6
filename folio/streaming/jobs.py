"""Digests, tokens, progress and snapshots with Structured Streaming; folio.streaming.lifecycle follows jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.stores import store

def hourly_digest(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Closed hours with their number of events and kinds (a stream of ts, event_type)."""
    rows = events.withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("event_type").alias("kinds"))
    return out.select(F.col("w.start").alias("start"), "n", "kinds")


def send_digests(events: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 hour"):
    """One batch an hour to `send`; a batch whose sending fails is sent again (at least once)."""
    writer = events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def live_tokens(tokens: DataFrame, ttl: str = "24 hours 5 minutes") -> DataFrame:
    """Each token once while it lives; its state goes when its time is over."""
    return tokens.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["token"])


def progress(polls: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The last poll and the greatest progress of each job, for update mode."""
    return polls.withWatermark("ts", delay).groupBy("job_id").agg(F.max("ts").alias("last_poll"), F.max("done_chunks").alias("done_chunks"))


def live_snapshots(jobs: DataFrame, tokens: DataFrame, keep: str = "24 hours", delay: str = "10 minutes") -> DataFrame:
    """Jobs (job_id, ts, ...) and tokens (job_id, created_at, ...) of two streams, joined as with_snapshot does: where both have a
    column the live job's value counts. A row without a partner comes out once none can come any more: a token is made
    within `keep` of its job's time."""
    both = [c for c in jobs.columns if c in tokens.columns and c != "job_id"]
    j, t = jobs.withWatermark("ts", delay).alias("j"), tokens.withWatermark("created_at", delay).alias("t")
    near = F.expr(f"j.job_id = t.job_id and t.created_at >= j.ts - interval {keep} and t.created_at <= j.ts + interval {keep}")
    pick = lambda c: F.coalesce(F.col(f"j.{c}"), F.col(f"t.{c}")).alias(c)
    own = [F.col(f"j.{c}") for c in jobs.columns if c not in (*both, "job_id")] + [F.col(f"t.{c}") for c in tokens.columns if c not in (*both, "job_id")]
    return j.join(t, near, "full_outer").select(pick("job_id"), *[pick(c) for c in both], *own)


def _versions(path: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    from pyarrow import fs

    files, root, _ = store(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    done = lambda p: files.get_file_info(f"{p}/_SUCCESS").type != fs.FileType.NotFound
    return sorted(int(f.base_name[2:]) for f in found if f.base_name.startswith("v=") and done(f.path))


def read_token_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of the table; None before the first."""
    versions = _versions(path)
    return spark.read.json(f"{path}/v={versions[-1]}", schema=TOKEN_ROWS) if versions else None


TOKEN_ROWS = "token string, job_id string, created_at timestamp, download_type string, lang string, podcast_mp3s array<string>"


def upsert_tokens(batch: DataFrame, batch_id: int, path: str, seconds: int = 24 * 3600 + 300) -> None:
    """Writes version batch_id of the token table: the version before with the batch's tokens in place of older ones of
    the same name, without those that are `seconds` older than the newest. A batch that comes again changes nothing."""
    spark = batch.sparkSession
    versions = _versions(path)
    if versions and versions[-1] >= batch_id:
        return
    rows = batch.select(*[x.split(" ")[0] for x in TOKEN_ROWS.split(", ")]).withColumn("turn", F.lit(1))
    before = read_token_table(spark, path)
    rows = rows if before is None else rows.unionByName(before.withColumn("turn", F.lit(0)))
    names = [c for c in rows.columns if c not in ("token", "turn")]
    newest = rows.groupBy("token").agg(F.max_by(F.struct(*names), F.struct("turn", "created_at")).alias("r")).select("token", "r.*")
    last = newest.agg(F.max("created_at").alias("last"))
    live = newest.join(F.broadcast(last), F.unix_timestamp("last") - F.unix_timestamp("created_at") <= seconds).drop("last")  # one row
    live.write.mode("overwrite").json(f"{path}/v={batch_id}")


def token_table(tokens: DataFrame, path: str, checkpoint: str, every: str | None = "1 minute"):
    """Keeps the token table at path up to date with a stream of tokens."""
    writer = tokens.writeStream.foreachBatch(lambda df, n: upsert_tokens(df, n, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
