"""Headings joined with entries of contents: equal, one within the other, or sharing most words.

No pair is made that doesn't share something rare. Equal titles meet by an equi-join. A title within another one has all
of its three-character grams there, so that it is looked up by the rarest of them. Of an entry's words at least 60 %
must be shared; then one of its rarest words is, as many as may be missing and one more. What meets is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text
from folio.session import cut

GRAM = 3
_BY = ["book_id", "file"]


def _grams(c: Column, size: int = GRAM) -> Column:
    """The different substrings of so many characters."""
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substr(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text.collapse(c), " "), lambda w: w != ""))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(book_id, file, inner, outer): titles of GRAM characters or more that may stand within others; each side: book_id, file, one title."""
    holds = outer.select(*_BY, "outer", F.explode(_grams(F.col("outer"))).alias("gram"))
    known = holds.groupBy(*_BY, "gram").agg(F.count("*").alias("n"))
    asked = inner.select(*_BY, "inner", F.size(_grams(F.col("inner"))).alias("size"), F.explode(_grams(F.col("inner"))).alias("gram"))
    met = asked.join(known, [*_BY, "gram"]).groupBy(*_BY, "inner", "size").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("rarest"))
    rare = met.where("found = size").select(*_BY, "inner", F.col("rarest.gram").alias("gram"))
    return rare.join(holds, [*_BY, "gram"]).where(F.contains("outer", F.col("inner"))).select(*_BY, "inner", "outer")


def _short_within(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(book_id, file, inner, outer): entries of less than GRAM characters within headings."""
    short = entries.where(F.length("inner") < GRAM)
    parts = F.array_union(*[_grams(F.col("outer"), n) for n in range(1, GRAM)])
    held = headings.join(short.select(*_BY).distinct(), _BY, "left_semi").select(*_BY, "outer", F.explode(parts).alias("inner"))
    return held.join(short, [*_BY, "inner"]).select(*_BY, "inner", "outer")


def _sharing_words(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """(book_id, file, norm, entry): headings with entries of which they share 60 % of two or more words."""
    own = headings.select(*_BY, "norm", _words(F.col("norm")).alias("own"))
    held = own.select(*_BY, "norm", "own", F.explode("own").alias("word"))
    known = held.groupBy(*_BY, "word").agg(F.count("*").alias("n"))
    many = entries.select(*_BY, "toc_norm", "entry", _words(F.col("toc_norm")).alias("words")).where("size(words) >= 2")
    # of n words ceil(0.6 n) must be shared
    rows = many.select(*_BY, "toc_norm", "entry", F.expr("(6 * size(words) + 9) div 10").alias("least"), F.explode("words").alias("word")).join(known, [*_BY, "word"])
    listed = rows.groupBy(*_BY, "toc_norm", "entry", "least").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("words")).where("size(words) >= least")
    # entries that no heading could tell apart are one, the first
    alike = listed.groupBy(*_BY, "words", "least").agg(F.min("entry").alias("entry"))
    # so many of them that one is shared if enough are, the rarest
    asked = alike.select(*_BY, "words", "least", "entry", F.explode(F.slice("words", F.lit(1), F.expr("size(words) - least + 1").cast("int"))).alias("w"))
    met = asked.select(*_BY, F.transform("words", lambda w: w["word"]).alias("words"), "least", "entry", F.col("w.word").alias("word")).join(held, [*_BY, "word"])
    return met.where(F.size(F.array_intersect("words", "own")) >= F.col("least")).select(*_BY, "norm", "entry")


def best_entries(headings: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, file, norm, toc_pos, toc_title): of each different normal title the entry of its file that fits best, then the first.

    headings: book_id, file, norm; toc: book_id, file, toc_pos, toc_title, toc_norm. Titles of less than three characters, empty
    and null ones fit nothing; titles that nothing fits are left out. Each way is tried for what the one before left.
    """
    wanted = cut(headings.where(F.length("norm") >= 3).distinct(), "headings")
    entries = cut(toc.where("toc_norm <> ''").groupBy(*_BY, "toc_norm").agg(F.min(F.struct("toc_pos", "toc_title")).alias("entry")), "contents")
    same = wanted.join(entries.withColumnRenamed("toc_norm", "norm"), [*_BY, "norm"]).select(*_BY, "norm", "entry")
    rest = wanted.join(same, [*_BY, "norm"], "left_anti")
    inner = entries.select(*_BY, F.col("toc_norm").alias("inner"))
    below = _within(inner.where(F.length("inner") >= GRAM), rest.withColumnRenamed("norm", "outer")).union(_short_within(inner, rest.withColumnRenamed("norm", "outer")))
    above = _within(rest.withColumnRenamed("norm", "inner"), inner.withColumnRenamed("inner", "outer"))
    pairs = below.select(*_BY, F.col("outer").alias("norm"), F.col("inner").alias("toc_norm")).union(above.select(*_BY, F.col("inner").alias("norm"), F.col("outer").alias("toc_norm")))
    held = cut(pairs.join(entries, [*_BY, "toc_norm"]).groupBy(*_BY, "norm").agg(F.min("entry").alias("entry")), "held")
    shared = _sharing_words(entries, rest.join(held, [*_BY, "norm"], "left_anti")).groupBy(*_BY, "norm").agg(F.min("entry").alias("entry"))
    return same.union(held).union(shared).select(*_BY, "norm", "entry.toc_pos", "entry.toc_title")
