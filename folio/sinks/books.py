"""Books as text, chapter files and manifests; logs and tokens as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from folio.functions import text
from folio.sources.stores import StagedWriter, save

# What stands between chapters and at the end.
PAUSE, END = "\n\n...\n\n", "\n\nFine.\n"


def book_text(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, text): title and author, then the chapters in order with pauses between them."""
    one = F.concat(text.format_heading(F.col("title")), F.lit("\n\n"), F.col("text"))
    body = F.sort_array(F.collect_list(F.struct("idx", one.alias("part"))))
    rows = chapters.groupBy("book_id").agg(F.array_join(F.transform(body, lambda x: x["part"]), PAUSE).alias("body"))
    head = F.concat("title", F.lit("\ndi "), "author", F.lit(PAUSE))
    return books.join(rows, "book_id", "left").select("book_id", F.concat(head, F.coalesce("body", F.lit("")), F.lit(END)).alias("text"))


def chapter_files(chapters: DataFrame) -> DataFrame:
    """(book_id, file, text) of each chapter."""
    body = F.concat(text.format_heading(F.col("title")), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    return chapters.select("book_id", text.chapter_filename(F.col("idx"), F.col("title")).alias("file"), body.alias("text"))


class _TextFiles(StagedWriter):
    def files_of(self, rows):
        for r in rows:
            yield f"{r['folder']}/{r['file']}", [r["text"].encode()]


class TextFiles(DataSource):
    """A sink of one file for each row of folder, file, text. All files get their names when all tasks are done, and
    none if one fails."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema, overwrite: bool) -> _TextFiles:
        return _TextFiles(self.options.get("path"), overwrite)


def write_text_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of book_id, file, text as path/<book_id>/<file>, many files a task. Books without an id are in the folder "book";
    null texts are empty files; two rows for one file are an error, and then nothing is written."""
    folder = F.coalesce(F.nullif(text.safe_filename(F.col("book_id").cast("string")), F.lit("")), F.lit("book"))
    save(files.select(folder.alias("folder"), "file", F.coalesce("text", F.lit("")).alias("text")), TextFiles, path, mode)


def write_chapter_files(chapters: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each book, in it a file NNN_title.txt for each chapter."""
    write_text_files(chapter_files(chapters), path, mode)


def write_feeds(feeds: DataFrame, path: str, mode: str = "overwrite") -> None:
    """feed.xml of each book (book_id, rss)."""
    write_text_files(feeds.select("book_id", F.lit("feed.xml").alias("file"), F.col("rss").alias("text")), path, mode)


def write_manifests(manifests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """manifest.json of each book (book_id, json)."""
    write_text_files(manifests.select("book_id", F.lit("manifest.json").alias("file"), F.col("json").alias("text")), path, mode)


def manifest(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, json): title, author, language, totals and chapters of each book."""
    tenth = lambda words: F.round(text.minutes(words), 1)
    one = F.struct(
        F.col("idx").alias("index"), "title", text.chapter_filename(F.col("idx"), F.col("title")).alias("file"),
        F.col("word_count").alias("words"), F.col("char_count").alias("chars"), tenth(F.col("word_count")).alias("estimated_minutes"),
    )
    rows = chapters.groupBy("book_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.sort_array(F.collect_list(one)).alias("chapters"))
    met = books.select("book_id", F.col("title").alias("book_title"), "author", "language").join(rows, "book_id")
    page = F.struct(F.col("book_title").alias("title"), "author", "language", F.col("n").alias("total_chapters"), F.col("words").alias("total_words"), tenth(F.col("words")).alias("estimated_duration_minutes"), "chapters")
    return met.select("book_id", F.to_json(page).alias("json"))


def summary(chapters: DataFrame) -> DataFrame:
    """What a console table of chapters shows."""
    return chapters.select("book_id", "idx", F.substring("title", 1, 45).alias("title"), "word_count", text.minutes(F.col("word_count"), 0).cast("long").alias("minutes"))


def append_activity(rows: DataFrame, path: str) -> None:
    """Adds log lines (session_id, ts, filename, operation), a folder for each month."""
    from folio.sources.logs import format_activity

    line = format_activity(F.col("session_id"), F.col("ts"), F.col("filename"), F.col("operation"))
    rows.select(line.alias("value"), F.date_format("ts", "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").text(path)


def save_tokens(tokens: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").json(path)
