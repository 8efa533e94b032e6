"""The EPUB source and its sink, members of archives, files that bear their names."""

import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from test_books import make_book

from folio.functions.text import chapter_filename
from folio.sinks import books as sink
from folio.sources import books, epub
from folio.sources.stores import listing


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "sub").mkdir()
    make_book(tmp_path / "one.epub")
    make_book(tmp_path / "sub" / "two.EPUB")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "cut.epub").write_bytes((tmp_path / "one.epub").read_bytes()[:-30])
    (tmp_path / "_hidden.epub").write_bytes(b"")
    (tmp_path / "other.txt").write_text("no book")
    return tmp_path


@pytest.mark.parametrize("size", ["33554432", "100"])
def test_rows_equal_whole_books(spark, shelf, size):
    whole = books.read_epub(spark, str(shelf)).where("error is null").cache()
    for kind, rows in (("pages", books.epub_pages(whole)), ("contents", books.epub_contents(whole)), ("entries", books.epub_entries(whole))):
        found = epub.read_epub_rows(spark, str(shelf), kind, range=size)
        assert found.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.collect())) and rows.count() > 5
    if size == "100":  # a book's pages are many tasks' work
        assert epub.read_epub_rows(spark, str(shelf / "one.epub"), range=size).rdd.getNumPartitions() > 5
    about = {Path(r.book_id).name: r for r in epub.read_epub_rows(spark, str(shelf), "books").collect()}
    assert about["one.epub"][1:] == ("My Book", "Ann", "en", "", "", None) and set(about) == {"one.epub", "two.EPUB", "bad.epub", "cut.epub"}
    assert about["bad.epub"].error and about["cut.epub"].error and about["bad.epub"].title is None


def test_filters_are_pushed_to_members(spark, shelf):
    reader = epub.EpubSource({"path": str(shelf), "range": "100"}).reader(epub.EpubSource({"path": ""}).schema())
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains, StringEndsWith

    rest = [StringContains(("name",), "x"), EqualTo(("html",), "x")]
    assert list(reader.pushFilters([StringEndsWith(("book_id",), "one.epub"), rest[0], GreaterThan(("pos",), 0), EqualTo(("name",), "OEBPS/a.xhtml"), rest[1]])) == rest
    assert {b for p in reader.partitions() for b, _, _ in p.parts} == {f"file:{shelf}/one.epub"}
    found = epub.read_epub_rows(spark, str(shelf)).where("pos > 0 and name like 'OEBPS/a%' and book_id like '%two.EPUB' and html like '%hill%'")
    assert [(r.pos, r.name) for r in found.collect()] == [(2, "OEBPS/a.xhtml")]
    assert epub.read_epub_rows(spark, str(shelf), most="10").count() == 0
    assert [Path(p).name for p, _ in listing(str(shelf), ".epub")] == ["bad.epub", "cut.epub", "one.epub", "two.EPUB"]


def test_members(spark, shelf):
    one = f"file:{shelf}/one.epub"
    asked = ["OEBPS/x.png", "OEBPS\\x.png", "else/X.PNG", "none", None]
    rows = spark.createDataFrame([(one, p) for p in asked] + [(f"{shelf}/bad.epub", "x"), (f"{shelf}/nowhere.epub", "x")], "book_id string, path string")
    got = {(Path(r.book_id).name, r.path): r for r in epub.read_members(rows).collect()}
    assert [(r.name, r.content) for p in asked for r in [got["one.epub", p]]] == [("OEBPS/x.png", b"png")] * 3 + [(None, None)] * 2
    assert got["bad.epub", "x"].error and got["nowhere.epub", "x"].error and not got["one.epub", "none"].error


def test_member_of_a_large_archive_takes_little_memory(tmp_path):
    with zipfile.ZipFile(tmp_path / "large.epub", "w") as z:
        with z.open("large.bin", "w", force_zip64=True) as f:
            for _ in range(300):
                f.write(bytes(1 << 20))
        z.writestr("small.txt", "found")
    code = f"import resource; from folio.sources.epub import Directory; d = Directory('{tmp_path}/large.epub'); print(d.file.read(d.find('A/SMALL.txt')).decode(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    word, mb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parent.parent, check=True).stdout.split()
    assert word == "found" and int(mb) < 200


def test_written_books_are_read_again(spark, tmp_path):
    rows = [("b", "T <&> \"x\"", i, f"d/{i} &.xhtml", f"<p>é {i}</p>") for i in (3, 1, 2)] + [("c", None, 1, "1.xhtml", None)]
    epub.write_epub(spark.createDataFrame(rows, "book_id string, title string, pos int, name string, html string").repartition(3), f"file://{tmp_path}/out")
    found = epub.read_epub_rows(spark, f"file://{tmp_path}/out").orderBy("book_id", "pos").collect()
    assert [(Path(r.book_id).name, r.pos, r.name, r.html) for r in found] == [*(("b.epub", i - 1, f"d/{i} &.xhtml", f"<p>é {i}</p>") for i in (1, 2, 3)), ("c.epub", 0, "1.xhtml", "")]
    assert sorted(r.title for r in epub.read_epub_rows(spark, f"file://{tmp_path}/out", "books").collect()) == ["T <&> \"x\"", "c"]


def files_below(path):
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_text_files_are_committed_together(spark, tmp_path):
    rows = spark.createDataFrame([("b/1", 1, "A: title?", "x"), ("b/1", 2, "B", None), (None, 1, "é", "y"), ("c", 1000, "D", "z")], "book_id string, idx int, title string, text string").repartition(3)
    named = rows.withColumn("file", chapter_filename(F.col("idx"), F.col("title")))
    sink.write_text_files(named, str(tmp_path / "out"))
    assert files_below(tmp_path / "out") == ["b1/001_A_title.txt", "b1/002_B.txt", "book/001_é.txt", "c/1000_D.txt"]

    @F.udf(StringType())
    def breaks(name):
        if name.startswith("002"):
            raise ValueError("a task fails")
        return name

    with pytest.raises(Exception, match="a task fails"):
        sink.write_text_files(named.withColumn("text", breaks("file")), str(tmp_path / "failed"))
    assert files_below(tmp_path / "failed") == []
    with pytest.raises(Exception, match="same name"):
        sink.write_text_files(named.union(named), str(tmp_path / "twice"))
    assert files_below(tmp_path / "twice") == []
    # another round replaces or adds, and a failed one leaves what was there
    sink.write_text_files(named.where("idx = 2"), str(tmp_path / "out"))
    assert files_below(tmp_path / "out") == ["b1/002_B.txt"]
    sink.write_text_files(named.where("idx = 1000"), str(tmp_path / "out"), "append")
    with pytest.raises(Exception, match="already there"):
        sink.write_text_files(named, str(tmp_path / "out"), "append")
    assert files_below(tmp_path / "out") == ["b1/002_B.txt", "c/1000_D.txt"]


def test_feeds_and_manifests_are_files(spark, tmp_path):
    sink.write_feeds(spark.createDataFrame([("b", "<rss/>")], "book_id string, rss string"), str(tmp_path / "out"))
    sink.write_manifests(spark.createDataFrame([("b", "{}")], "book_id string, json string"), str(tmp_path / "out"), "append")
    assert files_below(tmp_path / "out") == ["b/feed.xml", "b/manifest.json"] and (tmp_path / "out/b/feed.xml").read_text() == "<rss/>"
