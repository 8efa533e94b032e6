"""Readers for EPUB and plain text books, through Spark's binaryFile source (any store)."""

from __future__ import annotations

import io
import posixpath
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions import content, text

MOST_BYTES = 200 << 20

EPUB_SCHEMA = (
    "book_id string, title string, author string, language string, publisher string, description string,"
    " pages array<struct<pos:int,name:string,properties:array<string>,html:string>>,"
    " toc array<struct<pos:int,href_file:string,title:string>>,"
    " entries array<struct<pos:int,name:string,file_size:bigint,media_type:string,properties:array<string>,is_meta_cover:boolean>>, error string"
)


def _files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    glob = "".join(f"[{c}{c.upper()}]" for c in extension)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{glob}").load(path)
    return files.where(content.is_book_file(F.col("path"), F.col("length"), MOST_BYTES))


def _decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@F.pandas_udf(StringType())
def decode(files: pd.Series) -> pd.Series:
    """UTF-8, else Latin-1 (which never fails)."""
    return files.map(lambda b: _decode(bytes(b)), na_action="ignore")


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    """One chapter per text file: book_id (its path), idx, title from the name, text, counts,
    source_file. Files without words are left out."""
    rows = _files(spark, path, "txt").select(F.col("path").alias("book_id"), text.strip(decode("content")).alias("text")).where("text != ''")
    return rows.select(
        "book_id", F.lit(1).alias("idx"), text.title_from_stem(F.col("book_id")).alias("title"), "text",
        text.word_count(F.col("text")).alias("word_count"), text.char_count(F.col("text")).alias("char_count"), F.lit(None).cast("string").alias("source_file"),
    )


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _all(root, name: str):
    return [e for e in root.iter() if _local(e) == name] if root is not None else []


def _first(root, name: str) -> str | None:
    return next((t for e in _all(root, name) if (t := (e.text or "").strip())), None)


def _path(folder: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(folder, unquote(href.partition("#")[0])))


def _contents(book: zipfile.ZipFile, folder: str, items: list) -> list[tuple[int, str, str]]:
    """Entries of the contents depth first: of the navigation page or else of the NCX file."""
    out: list[tuple[int, str, str]] = []
    for href, kind, properties in items:
        nav = "nav" in properties
        if not nav and kind != "application/x-dtbncx+xml":
            continue
        try:
            root = ElementTree.fromstring(book.read(_path(folder, href)))
        except (KeyError, ElementTree.ParseError):
            continue
        if nav:
            tables = [n for n in _all(root, "nav") if any(k.endswith("type") and v == "toc" for k, v in n.attrib.items())]
            found = [(a.get("href"), "".join(a.itertext())) for n in tables[:1] for a in _all(n, "a")]
        else:
            found = [(c[0].get("src"), _first(p, "text") or "") for p in _all(root, "navPoint") if (c := [e for e in p if _local(e) == "content"])]
        out = [(i, h.partition("#")[0], " ".join(t.split())) for i, (h, t) in enumerate(found) if h and t.strip()]
        if out:
            break
    return out


#: What damaged archives and package files raise.
DAMAGE = (zipfile.BadZipFile, StopIteration, KeyError, ElementTree.ParseError)


def describe(path: str, book: zipfile.ZipFile) -> dict:
    """All of a book but its pages' text: metadata, names of pages in reading order, contents, archive entries."""
    names = book.namelist()
    try:
        place = _all(ElementTree.fromstring(book.read("META-INF/container.xml")), "rootfile")[0].get("full-path")
    except (KeyError, IndexError, ElementTree.ParseError):
        place = next(n for n in names if n.lower().endswith(".opf"))
    opf = ElementTree.fromstring(book.read(place))
    folder = posixpath.dirname(place)
    items = {i.get("id"): (i.get("href") or "", i.get("media-type") or "", (i.get("properties") or "").split()) for i in _all(opf, "item")}
    documents = [k for k, (_, kind, _p) in items.items() if "html" in kind]
    spine = [r.get("idref") for r in _all(opf, "itemref") if r.get("idref") in documents] or documents
    by_path = {_path(folder, h): (kind, p, k) for k, (h, kind, p) in items.items()}
    meta = next((m.get("content") for m in _all(opf, "meta") if m.get("name") == "cover"), None)
    there = set(names)
    pages = [(name, items[key][2]) for key in spine if (name := _path(folder, items[key][0])) in there]
    return {
        "book_id": path,
        "title": _first(opf, "title") or posixpath.splitext(posixpath.basename(path))[0],
        "author": _first(opf, "creator") or "unknown",
        "language": _first(opf, "language") or "",
        "publisher": _first(opf, "publisher") or "",
        "description": _first(opf, "description") or "",
        "pages": [{"pos": i, "name": name, "properties": properties} for i, (name, properties) in enumerate(pages)],
        "toc": [dict(zip(("pos", "href_file", "title"), row)) for row in _contents(book, folder, list(items.values()))],
        "entries": [
            {"pos": i, "name": z.filename, "file_size": z.file_size, "media_type": m[0], "properties": m[1], "is_meta_cover": m[2] == meta}
            for i, z in enumerate(book.infolist())
            for m in [by_path.get(z.filename, ("", [], None))]
        ],
        "error": None,
    }


def _epub(path: str, raw: bytes) -> dict:
    book = zipfile.ZipFile(io.BytesIO(raw))
    row = describe(path, book)
    for page in row["pages"]:
        page["html"] = book.read(page["name"]).decode("utf-8", "replace")
    return row


def _read(batches):
    names = [c.split(" ")[0] for c in ("book_id", "title", "author", "language", "publisher", "description", "pages", "toc", "entries", "error")]
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"]):
            try:
                row = _epub(path, bytes(raw))
            except DAMAGE as e:  # a damaged book is a row that says so
                row = dict.fromkeys(names) | {"book_id": path, "error": f"{type(e).__name__}: {e}"}
            yield pd.DataFrame([row], columns=names)


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """One row per book: metadata, pages in reading order, contents, archive entries, error. For books whose pages do
    not fit into a row folio.sources.epub has a row per page."""
    return _files(spark, path, "epub").select("path", "content").mapInPandas(_read, EPUB_SCHEMA)


def epub_pages(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.explode("pages").alias("p")).select("book_id", "p.*")


def epub_contents(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")


def epub_entries(books: DataFrame) -> DataFrame:
    return books.select("book_id", F.explode("entries").alias("e")).select("book_id", "e.*")
