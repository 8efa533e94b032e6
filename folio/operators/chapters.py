"""Books and chapters as rows: titles, sections, numbering, totals, previews, chunk plans.

A book is a group of rows; windows run over one book's chapters (a book's worth of rows, not
of text: texts are cut off before a window where it doesn't need them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import chunking, content, text
from folio.operators import titles


def file_titles(toc: DataFrame) -> DataFrame:
    """(book_id, href_file, title): the last entry of the contents for each file."""
    return toc.groupBy("book_id", "href_file").agg(F.max_by("title", "pos").alias("title"))


def shared_files(toc: DataFrame) -> DataFrame:
    """Files with two or more entries and their titles in order."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "title")))
    found = toc.groupBy("book_id", "href_file").agg(F.count("*").alias("entries"), F.transform(listed, lambda x: x["title"]).alias("titles"))
    return found.where("entries >= 2")


def match_headings(headings: DataFrame, toc: DataFrame) -> DataFrame:
    """Headings (book_id, file, pos, heading) with the entry of their file's contents that fits
    best: equal, containing, sharing words; then the first. Others are left out."""
    left = headings.withColumn("norm", text.normal_title(F.col("heading")))
    right = toc.select("book_id", F.col("href_file").alias("file"), F.col("pos").alias("toc_pos"), F.col("title").alias("toc_title"), text.normal_title(F.col("title")).alias("toc_norm"))
    best = titles.best_entries(left.select("book_id", "file", "norm"), right)
    return left.join(best, ["book_id", "file", "norm"]).select("book_id", "file", "pos", "heading", "toc_pos", F.col("toc_title").alias("title"))


def level_headings(headings: DataFrame) -> DataFrame:
    """Where no heading fits the contents: all those of the most frequent level (ties: seen first) of a file that has two or more."""
    by = ["book_id", "file"]
    counts = headings.groupBy(*by, "level").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy(*by).agg(F.max_by(F.struct("level", "n"), F.struct("n", -F.col("first"))).alias("b"))
    chosen = best.where("b.n >= 2").select(*by, F.col("b.level").alias("level"))
    short = F.when(F.length("heading") < 150, F.col("heading")).otherwise(F.substring("heading", 1, 100))
    return headings.join(chosen, [*by, "level"]).withColumn("title", short)


def sections(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """(book_id, file, section, title, text): text from each chosen heading to the next one.

    blocks: book_id, file, pos, level, text; starts: book_id, file, pos, title. Text before the
    first heading is left out; files with fewer than two headings have no sections.
    """
    by = ["book_id", "file"]
    many = starts.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 2").select(*by)
    at = starts.join(many, by, "left_semi").select(*by, "pos", "title", F.lit(True).alias("begins"))
    order = Window.partitionBy(*by).orderBy("pos")
    numbered = blocks.join(at, [*by, "pos"], "left").withColumn("section", F.count("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("begins").isNull(), F.struct("pos", "text")))), lambda x: x["text"])
    out = numbered.where("section > 0").groupBy(*by, "section").agg(F.max("title").alias("title"), F.array_join(body, "").alias("text"))
    return out


def number_chapters(pieces: DataFrame, order: tuple[str, ...] = ("spine_pos", "section"), fallback: str = "Section ") -> DataFrame:
    """Accepted pieces with idx 1, 2, ... in their book; those without a title are named by it."""
    idx = F.row_number().over(Window.partitionBy("book_id").orderBy(*order))
    out = pieces.where(content.is_content(F.col("text"), F.col("title"))).withColumn("idx", idx)
    named = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit(fallback), F.col("idx"))).otherwise(F.col("title"))
    return out.withColumn("title", named)


def with_counts(chapters: DataFrame) -> DataFrame:
    return chapters.withColumns({"word_count": text.word_count(F.col("text")), "char_count": text.char_count(F.col("text"))})


def finish_text(chapters: DataFrame) -> DataFrame:
    """The title goes from the start of the text; counts are those of what is left."""
    return with_counts(chapters.withColumn("text", text.strip(text.remove_leading_title(F.col("text"), F.col("title")))))


def build_book(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters of books from spine pages (book_id, pos, name, properties, html) and contents."""
    from folio.functions.html import html_blocks, html_title, html_to_text

    kept = pages.where(~content.is_front_file(F.col("name")) & ~content.has_skipped_property(F.col("properties")) & ~content.has_skipped_type(F.col("html")))
    kept = kept.withColumn("file", F.regexp_replace("name", r"^.*/", ""))
    titled = toc.withColumn("href_file", F.regexp_replace("href_file", r"^.*/", ""))
    shared = shared_files(titled).select("book_id", F.col("href_file").alias("file"))
    many = kept.join(shared, ["book_id", "file"], "left_semi")
    blocks = many.select("book_id", "file", F.col("pos").alias("spine_pos"), F.explode(html_blocks("html")).alias("b")).select("book_id", "file", "spine_pos", "b.*")
    heads = blocks.where("level > 0").withColumnRenamed("text", "heading")
    met = match_headings(heads.select("book_id", "file", "pos", "heading"), titled)
    rest = level_headings(heads.join(met, ["book_id", "file"], "left_anti"))
    parts = sections(blocks, met.select("book_id", "file", "pos", "title").union(rest.select("book_id", "file", "pos", "title")))
    place = many.select("book_id", "file", F.col("pos").alias("spine_pos"))
    split = parts.join(place, ["book_id", "file"]).select("book_id", "file", "spine_pos", "section", "title", "text")
    whole = kept.join(split, ["book_id", "file"], "left_anti").join(file_titles(titled).withColumnRenamed("href_file", "file"), ["book_id", "file"], "left")
    whole = whole.select("book_id", "file", F.col("pos").alias("spine_pos"), F.lit(0).cast("long").alias("section"), F.coalesce("title", html_title("html")).alias("title"), html_to_text(F.col("html")).alias("text"))
    # explode keeps the cleaning from being repeated in every later expression on the text
    out = split.union(whole).select("book_id", "file", "spine_pos", "section", "title", F.explode(F.array(text.clean_text(F.col("text")))).alias("text"))
    return finish_text(number_chapters(out)).select("book_id", "idx", "title", "text", "word_count", "char_count", F.col("file").alias("source_file"))


def book_totals(chapters: DataFrame) -> DataFrame:
    """Chapters, words, characters and minutes of each book."""
    out = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("word_count").alias("total_words"), F.sum("char_count").alias("total_chars"))
    return out.withColumn("minutes", text.minutes(F.col("total_words")))


def selected(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chapters whose (book_id, idx) is wanted."""
    return chapters.join(wanted.select("book_id", "idx"), ["book_id", "idx"], "left_semi")


def preview(chapters: DataFrame, *, plain: bool = False) -> DataFrame:
    """(book_id, preview): from the second content chapter of 80 words or more, else the first,
    else the first of 150 characters; plain: only the last rule. "" if there is none."""
    bare = text.strip(F.coalesce("text", F.lit("")))
    good = F.lit(False) if plain else content.is_content(F.col("text"), F.col("title")) & (F.col("word_count") >= 80)
    marked = chapters.select("book_id", "idx", bare.alias("text"), good.alias("good"))
    place = F.row_number().over(Window.partitionBy("book_id", "good").orderBy("idx"))
    marked = marked.withColumn("place", place).withColumn("rank", F.when(F.col("good"), F.when(F.col("place") == 2, 0).when(F.col("place") == 1, 1)).when(F.length("text") >= 150, 2))
    best = marked.groupBy("book_id").agg(F.min_by(F.when(F.col("rank").isNotNull(), F.col("text")), F.when(F.col("rank").isNotNull(), F.struct("rank", "idx"))).alias("text"))
    return best.select("book_id", F.coalesce(text.trim_preview(F.col("text")), F.lit("")).alias("preview"))


def plan_chunks(chapters: DataFrame, most: int = chunking.CHUNK_CHARS, stripped: Column | None = None) -> DataFrame:
    """Chunks of each chapter: the title as a sentence, then the text without brackets."""
    body = text.strip_parentheses(F.col("text")) if stripped is None else stripped
    rows = chapters.select("book_id", F.col("idx").alias("chapter_index"), F.col("title").alias("chapter_title"), F.concat(F.col("title"), F.lit(".\n\n"), body).alias("spoken"))
    cut = chunking.chunked(rows, F.col("spoken"), most)
    return cut.select("book_id", "chapter_index", "chapter_title", F.col("chunks").alias("chunks_in_chapter"), "chunk_index", F.col("chunk").alias("text"), F.length("chunk").alias("chars"))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("book_id").agg(F.count("*").alias("total_chunks"), F.sum("chars").cast("long").alias("total_chars"))


def chunk_progress(chunks: DataFrame) -> DataFrame:
    """Adds starts_chapter (a pause goes before it), done_chunks and done_chars so far."""
    order = Window.partitionBy("book_id").orderBy("chapter_index", "chunk_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("chapter_index").over(order)
    return chunks.withColumns({
        "starts_chapter": F.coalesce(before != F.col("chapter_index"), F.lit(False)),
        "done_chunks": F.count("*").over(so_far),
        "done_chars": F.sum("chars").over(so_far),
    })
