"""Catalogues: voices by language, covers and members of archives, feeds, site maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import rules, text


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def language_name(code: Column) -> Column:
    return F.coalesce(F.element_at(_map(rules.LANGUAGES), code), code)


def language_priority(code: Column) -> Column:
    return F.coalesce(F.element_at(_map(rules.LANGUAGE_PRIORITY), code), F.lit(99))


def default_voice(language: Column) -> Column:
    """The voice of a book by the first two letters of its language; books without one count as of the first language."""
    given = F.coalesce(language, F.lit(""))
    code = F.when(given == "", rules.VOICE_LANGUAGE).otherwise(F.lower(F.substring(given, 1, 2)))
    return F.when(code == rules.VOICE_LANGUAGE, rules.VOICE_OWN).otherwise(rules.VOICE_OTHER)


def voice_catalogue(voices: DataFrame) -> DataFrame:
    """One row per language in display order: code, name, place, voices by gender and name."""
    code = text.language_of(F.col("locale"))
    one = F.struct("gender", text.voice_name(F.col("short_name")).alias("name"), F.col("short_name").alias("id"), "locale", F.when(F.col("gender") == "Female", "♀").otherwise("♂").alias("gender_icon"))
    out = voices.select(code.alias("code"), one.alias("v")).groupBy("code").agg(F.sort_array(F.collect_list("v")).alias("voices"))
    out = out.withColumns({"name": language_name(F.col("code")), "priority": language_priority(F.col("code"))})
    return out.orderBy("priority", "name")  # as many rows as languages


def _base(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^.*/", ""))


def cover(entries: DataFrame, least: int = 5000) -> DataFrame:
    """The cover of each book: the entry with the cover property, that named by the metadata
    (is_meta_cover), one of a known name, the largest image above `least` bytes; ties: the first."""
    image = F.coalesce(F.col("media_type").startswith("image/"), F.lit(False))
    rank = (
        F.when(image & F.coalesce(F.array_contains("properties", "cover-image"), F.lit(False)), 0)
        .when(image & F.coalesce("is_meta_cover", F.lit(False)), 1)
        .when(_base(F.col("name")).isin(*rules.COVER_NAMES), 2)
        .when(F.lower("name").rlike(r"\.(jpg|jpeg|png)$") & (F.col("file_size") > least), 3)
    )
    size = F.when(F.col("rank") == 3, -F.col("file_size")).otherwise(F.lit(0))
    ranked = entries.withColumn("rank", rank).where("rank is not null")
    return ranked.groupBy("book_id").agg(F.min_by("name", F.struct("rank", size, "pos")).alias("cover"))


def find_member(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(book_id, path, name): the entry of exactly that path, of it with plain slashes, or of its
    last part in any case; ties: the first."""
    flat = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    met = entries.join(wanted.select("book_id", "path"), "book_id")
    rank = F.when(F.col("name") == F.col("path"), 0).when(flat(F.col("name")) == flat(F.col("path")), 1).when(_base(F.col("name")) == _base(F.col("path")), 2)
    met = met.withColumn("rank", rank).where("rank is not null")
    return met.groupBy("book_id", "path").agg(F.min_by("name", F.struct("rank", "pos")).alias("name"))


def feed_items(files: DataFrame, chapters: DataFrame, now: Column, base_url: str = "") -> DataFrame:
    """Items of the feed of each book: files (book_id, name, file_size) in order of name, with the
    chapter that the number before the first _ names. Dates step back an hour from the last."""
    place = Window.partitionBy("book_id")
    number = F.regexp_extract("name", r"^\s*(\d{1,9})\s*(?:_|$)", 1)
    rows = files.withColumns({
        "episode": F.row_number().over(place.orderBy("name")),
        "episodes": F.count("*").over(place),
        "idx": F.when(number != "", number.cast("int")),
    })
    met = rows.join(chapters.select("book_id", "idx", F.col("title").alias("chapter")), ["book_id", "idx"], "left")
    title = F.coalesce("chapter", F.concat(F.lit("Episode "), F.col("episode")))
    seconds = text.audio_seconds(F.col("file_size"))
    date = F.timestamp_add("HOUR", F.col("episode") - F.col("episodes"), now)
    url = F.concat(F.lit(base_url.rstrip("/") + "/" if base_url else ""), F.col("name"))
    return met.select(
        "book_id", "episode", "name", "file_size", title.alias("title"),
        F.when(F.col("chapter").isNotNull(), F.concat(F.lit("Chapter "), F.col("idx"), F.lit(": "), F.col("chapter"))).otherwise(title).alias("description"),
        text.clock(seconds).alias("duration"), text.rfc2822(date).alias("pub_date"), url.alias("url"),
        text.name_uuid(F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("name"))).alias("guid"),
    )


def feed(items: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, rss): an RSS 2.0 document for each book (book_id, title, author)."""
    e = lambda c: text.escape_markup(F.col(c))
    parts = [
        "<item><title>", e("title"), "</title><description>", e("description"), "</description><itunes:episode>", F.col("episode").cast("string"),
        "</itunes:episode><itunes:duration>", F.col("duration"), "</itunes:duration><pubDate>", F.col("pub_date"), "</pubDate><link>", e("url"),
        '</link><guid isPermaLink="false">', F.col("guid"), '</guid><enclosure url="', e("url"), '" length="', F.col("file_size").cast("string"), '" type="audio/mpeg"/></item>',
    ]
    one = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows = items.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("episode", one.alias("xml")))).alias("xml"))
    head = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>'
    met = rows.join(books.select("book_id", "title", "author"), "book_id")
    return met.select("book_id", F.concat(F.lit(head), e("title"), F.lit("</title><itunes:author>"), e("author"), F.lit("</itunes:author>"), F.array_join(F.transform("xml", lambda x: x["xml"]), ""), F.lit("</channel></rss>")).alias("rss"))


def site_map(spark: SparkSession, base_url: str, languages: DataFrame | None = None) -> DataFrame:
    """(place, loc, priority, hreflang, href): each page of the site, which has a root and one for each language (code; by default
    those of the rules), with its alternates."""
    if languages is None:
        languages = spark.createDataFrame([(c,) for c in rules.SITE_LANGUAGES], "code string")
    tag = F.coalesce(F.element_at(_map(rules.SITE_LANGUAGES), F.col("code")), F.col("code"))
    listed = languages.select("code", tag.alias("hreflang"), F.row_number().over(Window.orderBy("code")).alias("place"), F.concat(F.lit(f"{base_url}/"), "code", F.lit("/")).alias("href"))  # as many rows as languages
    root = spark.createDataFrame([(0, f"{base_url}/", 1.0)], "place int, loc string, priority double")
    pages = root.union(listed.select("place", F.col("href").alias("loc"), F.lit(0.9)))
    other = listed.select("hreflang", "href").union(spark.createDataFrame([("x-default", f"{base_url}/")], "hreflang string, href string"))
    return pages.crossJoin(F.broadcast(other))  # languages by languages, whatever the data


def robots(base_url: str = "") -> str:
    lines = ["User-agent: *", "Allow: /", "Disallow: /api/", "Disallow: /data/", "Disallow: /dl/"]
    return "\n".join(lines + ([f"Sitemap: {base_url}/sitemap.xml"] if base_url else []))


def faq_json(faqs: DataFrame) -> DataFrame:
    """(lang, json): questions (lang, pos, question, answer) as a FAQPage document."""
    item = F.struct(F.lit("Question").alias("@type"), F.col("question").alias("name"), F.struct(F.lit("Answer").alias("@type"), F.col("answer").alias("text")).alias("acceptedAnswer"))
    rows = faqs.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("items"))
    page = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.transform("items", lambda x: x["item"]).alias("mainEntity"))
    return rows.select("lang", F.to_json(page).alias("json"))


def site_content(wanted: DataFrame, table: DataFrame, default: str = "en") -> DataFrame:
    """Rows of wanted (lang, ...) with the content of their language, or of the default one."""
    known = table.select("lang", F.struct(*[c for c in table.columns if c != "lang"]).alias("own"))
    other = table.where(F.col("lang") == default).select(F.struct(*[c for c in table.columns if c != "lang"]).alias("other"))
    met = wanted.join(F.broadcast(known), "lang", "left").crossJoin(F.broadcast(other))  # one row a language
    return met.select(*wanted.columns, F.coalesce("own", "other").alias("c")).select(*wanted.columns, "c.*")
