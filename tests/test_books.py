"""Books from files to chapters, chunks, manifests; HTML; catalogues."""

import json
import zipfile

from pyspark.sql import functions as F

from folio import session
from folio.functions import html
from folio.operators import catalogue, chapters
from folio.sinks import books as sink
from folio.sources import books, logs

STORY = "This is the {} part of a story in which many things happen to many people every day. " * 6
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> My Book </dc:title><dc:creator>Ann</dc:creator><dc:language>en</dc:language><meta name="cover" content="img"/></metadata>
<manifest><item id="cov" href="cover.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/>
<item id="img" href="x.png" media-type="image/png"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="cov"/><itemref idref="b"/><itemref idref="a"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Second</text></navLabel><content src="b.xhtml"/></navPoint>
<navPoint><navLabel><text>The Hill</text></navLabel><content src="a.xhtml#h1"/></navPoint><navPoint><navLabel><text>The Sea</text></navLabel><content src="a.xhtml#h2"/></navPoint></navMap></ncx>"""


def make_book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/book.opf", OPF)
        z.writestr("OEBPS/toc.ncx", NCX)
        z.writestr("OEBPS/x.png", b"png")
        z.writestr("OEBPS/cover.xhtml", "<html><body>cover</body></html>")
        z.writestr("OEBPS/b.xhtml", f"<html><head><title>t</title></head><body><h1>Second</h1><p>{STORY.replace('{}', str('b'))}</p></body></html>")
        z.writestr("OEBPS/a.xhtml", f"<html><body><p>lost</p><h2>The Hill</h2><p>{STORY.replace('{}', str('hill'))}</p><h2>The Sea</h2><p>{STORY.replace('{}', str('sea'))}</p></body></html>")


def test_epub(spark, tmp_path):
    make_book(tmp_path / "one.epub")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    rows = books.read_epub(spark, str(tmp_path)).cache()
    assert [bool(r.error) for r in rows.orderBy("book_id").collect()] == [True, False]
    good = rows.where("error is null")
    assert good.select("title", "author", "language").first() == ("My Book", "Ann", "en")
    built = chapters.build_book(books.epub_pages(good), books.epub_contents(good)).orderBy("idx").collect()
    assert [(r.idx, r.title, r.source_file) for r in built] == [(1, "Second", "b.xhtml"), (2, "The Hill", "a.xhtml"), (3, "The Sea", "a.xhtml")]
    assert "hill" in built[1].text and "sea" not in built[1].text and built[0].word_count == len(built[0].text.split())
    assert catalogue.cover(books.epub_entries(good)).first().cover == "OEBPS/x.png"


def test_txt(spark, tmp_path):
    (tmp_path / "my_first-book.txt").write_text(" Hello there \n", encoding="utf-8")
    (tmp_path / "old.txt").write_bytes("caffè".encode("latin-1"))
    (tmp_path / "empty.txt").write_text("  \n")
    got = {r.title: (r.text, r.word_count) for r in books.read_txt(spark, str(tmp_path)).collect()}
    assert got == {"my first book": ("Hello there", 2), "old": ("caffè", 1)}


def test_page_text():
    page = "<html><head><title>T</title><script>x</script></head><body><nav>menu</nav><h1>A <b>b</b></h1><p>One<p>Two<br>three <a href='#fn1'>9</a><a href='x'>12</a><sup>1</sup><ul><li>first<li>second</ul><hr><!-- c --><div class='Footnotes'>gone</div>end</body></html>"
    got = html.page_text(page)
    assert got.split() == "Ab One Two three first. second. end".split()
    assert "\n\nAb\n\n" in got and "Two\nthree" in got
    assert " c " in html.page_text(page, comments=True)
    assert html.page_text("") == "" and html.page_text("<p>deep" + "<div>" * 5000 + "x").split() == ["deep", "x"]
    assert html.page_title("<title>untitled</title><h2>Two</h2>") == "Two" and html.page_title("<title>Untitled</title>") is None


def test_references_without_a_semicolon_are_text():
    page = "<h1>A &amp; B &lt;c&gt; &amp&eacute;&amp</h1><p>&ampx; &quo &#38; R&D &copy; &copy <!-- &amp &amp; --></p>"
    assert html.page_title(page) == "A & B <c> &ampé&amp"
    assert html.page_text(page).split() == "A & B <c> &ampé&amp &ampx; &quo & R&D © &copy".split()
    assert " &amp &amp; " in html.page_text(page, comments=True) and html.page_title("<h1>\ue000 &amp &amp;</h1>") == "\ue000 &amp &"


def chapter_rows(spark):
    rows = [("b", i, f"Chapter {i}", STORY.replace('{}', str(i)), 100, 500) for i in (2, 1, 3)]
    return spark.createDataFrame(rows, "book_id string, idx int, title string, text string, word_count long, char_count long")


def test_totals_and_sinks(spark, tmp_path):
    rows = chapter_rows(spark)
    one = spark.createDataFrame([("b", "T", "A", "en"), ("none", "N", "A", "en")], "book_id string, title string, author string, language string")
    assert chapters.book_totals(rows).first().total_words == 300
    written = {r.book_id: r.text for r in sink.book_text(rows, one).collect()}
    assert written["none"] == "N\ndi A\n\n...\n\n\n\nFine.\n" and written["b"].startswith("T\ndi A\n\n...\n\nChapter 1.\n\nThis")
    page = json.loads(sink.manifest(rows, one).first().json)
    assert page["total_words"] == 300 and [c["file"] for c in page["chapters"]] == ["001_Chapter_1.txt", "002_Chapter_2.txt", "003_Chapter_3.txt"]
    sink.write_chapter_files(rows, str(tmp_path / "out"))
    assert sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["b/001_Chapter_1.txt", "b/002_Chapter_2.txt", "b/003_Chapter_3.txt"]
    assert (tmp_path / "out/b/001_Chapter_1.txt").read_text().startswith("Chapter 1.\n\nThis is")
    plan = chapters.plan_chunks(rows, 200)
    assert chapters.chunk_totals(plan).first().total_chunks == plan.count()
    marks = chapters.chunk_progress(plan).orderBy("chapter_index", "chunk_index").collect()
    assert sum(r.starts_chapter for r in marks) == 2 and marks[-1].done_chars == sum(r.chars for r in marks)
    assert chapters.preview(rows).first().preview.startswith("This is the 2 part")


def test_level_headings(spark):
    heads = spark.createDataFrame([("b", "f", 1, 2, "x"), ("b", "f", 2, 3, "y"), ("b", "f", 3, 3, "z"), ("b", "g", 1, 1, "w")], "book_id string, file string, pos int, level int, heading string")
    assert sorted(r.title for r in chapters.level_headings(heads).collect()) == ["y", "z"]


def test_members_feed_and_content(spark):
    entries = spark.createDataFrame([("b", 0, "A\\b.TXT"), ("b", 1, "c/b.txt")], "book_id string, pos int, name string")
    wanted = spark.createDataFrame([("b", "A/b.TXT"), ("b", "z/B.txt")], "book_id string, path string")
    assert {r.path: r.name for r in catalogue.find_member(entries, wanted).collect()} == {"A/b.TXT": "A\\b.TXT", "z/B.txt": "A\\b.TXT"}
    files = spark.createDataFrame([("b", "001_x.mp3", 96000), ("b", "zz.mp3", 10)], "book_id string, name string, file_size long")
    items = catalogue.feed_items(files, chapter_rows(spark), F.lit("2026-01-02 03:00:00").cast("timestamp"))
    assert [(r.title, r.duration, r.pub_date) for r in items.orderBy("episode").collect()] == [("Chapter 1", "00:00:16", "Fri, 02 Jan 2026 02:00:00 +0000"), ("Episode 2", "00:00:01", "Fri, 02 Jan 2026 03:00:00 +0000")]
    rss = catalogue.feed(items, spark.createDataFrame([("b", "T & U", "A")], "book_id string, title string, author string")).first().rss
    assert "<title>T &amp; U</title>" in rss and rss.count("<item>") == 2
    faq = catalogue.faq_json(spark.createDataFrame([("en", 1, "Q1", "A1"), ("en", 0, "Q0", "A0")], "lang string, pos int, question string, answer string")).first().json
    assert [x["name"] for x in json.loads(faq)["mainEntity"]] == ["Q0", "Q1"]
    table = spark.createDataFrame([("en", "hello"), ("it", "ciao")], "lang string, heading string")
    asked = spark.createDataFrame([("it",), ("xx",)], "lang string")
    assert {r.lang: r.heading for r in catalogue.site_content(asked, table).collect()} == {"it": "ciao", "xx": "hello"}
    assert catalogue.robots("https://x").endswith("Sitemap: https://x/sitemap.xml")


def test_logs_and_tokens(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 'odd "name" # x.epub', "ANALYZE")], "session_id string, filename string, operation string").withColumn("ts", F.lit("2026-02-03 04:05:06").cast("timestamp"))
    sink.append_activity(rows, str(tmp_path / "log"))
    assert logs.read_activity(spark, str(tmp_path / "log")).select("session_id", "filename", "operation").first() == ("s1", 'odd "name" # x.epub', "ANALYZE")
    tokens = spark.sql("select 't' || id as token, 'j' || id as job_id, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,id) as created_at, 'audio' as download_type, 'en' as lang, array('a') as podcast_mp3s from range(3)")
    sink.save_tokens(tokens, str(tmp_path / "tokens"))
    back = logs.read_tokens(spark, str(tmp_path / "tokens"))
    folders = spark.createDataFrame([("j2",), ("j9",)], "job_id string")
    live = logs.live_tokens(back, F.lit("2026-01-03 00:04:00").cast("timestamp"), folders)
    assert [r.token for r in live.collect()] == ["t2"]
    jobs = folders.where("false")
    assert [r.job_id for r in logs.orphan_folders(folders, back, jobs).collect()] == ["j9"]


def test_listing_many_folders_takes_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"b{i}").mkdir()
        (tmp_path / f"b{i}" / "001_x.txt").write_text(f"{i}")
    session.ship_package(spark)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        found = spark.read.text(str(tmp_path), wholetext=True, recursiveFileLookup=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert found.count() == 60 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
