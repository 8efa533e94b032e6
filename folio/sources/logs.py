"""Readers for activity logs, token tables and voice lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a line of the log. The name may hold quotes and #.
LINE = r'^(\S+) # (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) # "(.*)" # ([A-Z_]+)$'
TOKEN_SCHEMA = "token string, job_id string, created_at timestamp, download_type string, lang string, podcast_mp3s array<string>"
#: Tokens live a day, and five minutes more.
TOKEN_SECONDS = 24 * 3600 + 300


def parse_activity(line: Column) -> Column:
    """struct(session_id, ts, filename, operation); null for lines of another form."""
    part = lambda k: F.regexp_extract(line, LINE, k)
    row = F.struct(part(1).alias("session_id"), F.try_to_timestamp(part(2), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), part(3).alias("filename"), part(4).alias("operation"))
    return F.when(line.rlike(LINE), row)


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(parse_activity(F.col("value")).alias("a"))
    return lines.where("a is not null").select("a.*")


def format_activity(session_id: Column, ts: Column, filename: Column, operation: Column) -> Column:
    return F.concat(session_id, F.lit(" # "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(' # "'), filename, F.lit('" # '), operation)


def live_tokens(tokens: DataFrame, now: Column, folders: DataFrame | None = None) -> DataFrame:
    """Tokens that are not too old and (folders: job_id) whose job still has its folder."""
    out = tokens.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= TOKEN_SECONDS)
    return out if folders is None else out.join(folders.select("job_id"), "job_id", "left_semi")


def orphan_folders(folders: DataFrame, tokens: DataFrame, jobs: DataFrame) -> DataFrame:
    """Folders that neither a token nor a job needs."""
    used = tokens.select("job_id").union(jobs.select("job_id"))
    return folders.join(used, "job_id", "left_anti")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_SCHEMA).json(path)


def read_voices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("short_name string, locale string, gender string").json(path)
