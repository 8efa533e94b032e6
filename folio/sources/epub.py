"""EPUB books as a Spark data source, a row per page, and single members of any archive.

Nobody reads an archive as a whole: its directory stands at the file's end, and a member is read from its own place.
A partition is a range of bytes of a book and reads the members that begin in it, so that one large book is many
tasks' work; small books share a partition. The driver lists files and opens none.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folio.sources.books import DAMAGE, MOST_BYTES, describe
from folio.sources.stores import StagedWriter, arrays, listing, save, store

#: Columns of each kind of rows.
SCHEMAS = {
    "pages": "book_id string, pos int, name string, properties array<string>, html string",
    "contents": "book_id string, pos int, href_file string, title string",
    "entries": "book_id string, pos int, name string, file_size bigint, media_type string, properties array<string>, is_meta_cover boolean",
    "books": "book_id string, title string, author string, language string, publisher string, description string, error string",
}
#: A partition has about so many bytes of archives.
RANGE = 32 << 20
#: Pages are handed on when they have so many bytes together.
BATCH_BYTES = 4 << 20

_TESTS = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class Ranges(InputPartition):
    """(book, first byte, end) of what a task reads."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


def archive(address: str) -> zipfile.ZipFile:
    """An archive that is read in place."""
    files, path, _ = store(address)
    try:
        return zipfile.ZipFile(files.open_input_file(path))
    except pa.ArrowInvalid as e:  # a place outside the file
        raise zipfile.BadZipFile(str(e)) from e


class EpubReader(DataSourceReader):
    def __init__(self, schema, path: str, rows: str, size: int, most: int):
        self.schema, self.path, self.rows, self.size, self.most = schema, path, rows, size, most
        self.tests: dict[str, list] = {"book_id": [], "pos": [], "name": []}

    def pushFilters(self, filters):
        """Filters on the book, the place and the name are done here: other members are not read."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _TESTS and column in self.tests and (column == "book_id" or column in SCHEMAS[self.rows]):
                self.tests[column].append((type(f), f.value))
            else:
                yield f

    def _passes(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, wanted) for kind, wanted in self.tests[column])

    def partitions(self):
        out, own, held = [], [], 0
        for book, size in listing(self.path, ".epub"):
            if size > self.most or not self._passes("book_id", book):
                continue
            step = self.size if self.rows == "pages" else max(size, 1)
            for begin in range(0, max(size, 1), step):
                own.append((book, begin, min(begin + step, max(size, 1))))
                held += own[-1][2] - begin if self.rows == "pages" else 1 << 16
                if held >= self.size:
                    out.append(Ranges(own))
                    own, held = [], 0
        return [*out, Ranges(own)] if own or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        held, size = [], 0
        for part in partition.parts:
            for row, weight in self._rows(*part):
                held.append(tuple(row.get(f.name) for f in schema))
                size += weight + 256
                if size >= BATCH_BYTES:
                    yield arrays(schema, held)
                    held, size = [], 0
        if held:
            yield arrays(schema, held)

    def _rows(self, address: str, begin: int, end: int) -> Iterator[tuple[dict, int]]:
        try:
            with archive(address) as book:
                about = describe(address, book)
                if self.rows == "books":
                    yield about, 0
                for row in about[{"contents": "toc", "books": "none"}.get(self.rows, self.rows)] if self.rows != "books" else ():
                    if not (self._passes("pos", row["pos"]) and ("name" not in row or self._passes("name", row["name"]))):
                        continue
                    if self.rows == "pages":
                        if not begin <= book.getinfo(row["name"]).header_offset < end:
                            continue
                        raw = book.read(row["name"])
                        row["html"] = raw.decode("utf-8", "replace")
                        yield row | {"book_id": address}, len(raw)
                    else:
                        yield row | {"book_id": address}, 0
        except DAMAGE as e:
            if self.rows == "books":
                yield {"book_id": address, "error": f"{type(e).__name__}: {e}"}, 0


class EpubWriter(StagedWriter):
    """A book of each book_id: rows of book_id, title, pos, name, html, those of a book one after the other and in order."""

    def files_of(self, rows):
        held, book = None, None
        for r in rows:
            if held is None or r["book_id"] != book:
                if held is not None:
                    yield held.closed()
                held, book = _Archive(str(r["book_id"]), r["title"]), r["book_id"]
            held.add(r["name"], r["html"])
        if held is not None:
            yield held.closed()


class _Archive:
    """A book that grows page by page; what is written so far is handed on as parts."""

    CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf"/></rootfiles></container>'

    def __init__(self, book: str, title: str | None):
        self.book, self.title, self.names, self.raw = book, title or book, [], io.BytesIO()
        self.file = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_DEFLATED)
        self.file.writestr("META-INF/container.xml", self.CONTAINER)

    def add(self, name: str, html: str | None) -> None:
        self.names.append(name)
        self.file.writestr(name, html or "")

    def closed(self) -> tuple[str, list[bytes]]:
        from xml.sax.saxutils import escape, quoteattr

        items = "".join(f'<item id="p{i}" href={quoteattr(n)} media-type="application/xhtml+xml"/>' for i, n in enumerate(self.names))
        spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(self.names)))
        head = f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(self.title)}</dc:title></metadata>'
        self.file.writestr("book.opf", f'<package xmlns="http://www.idpf.org/2007/opf">{head}<manifest>{items}</manifest><spine>{spine}</spine></package>')
        self.file.close()
        return f"{self.book}.epub", [self.raw.getbuffer()]


class EpubSource(DataSource):
    """spark.read.format("epub").option("rows", "pages" | "contents" | "entries" | "books").load(path)

    Files of other names and of more than `most` bytes are passed over. A damaged book is a row with an error
    among the books, and has no other rows. Writing takes rows of book_id, title, pos, name, html (see write_epub).
    """

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "pages")]

    def reader(self, schema: StructType) -> EpubReader:
        get = self.options.get
        return EpubReader(schema, get("path"), get("rows", "pages"), int(get("range", RANGE)), int(get("most", MOST_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options.get("path"), overwrite)


def read_epub_rows(spark: SparkSession, path: str, rows: str = "pages", **options: str) -> DataFrame:
    """Pages in reading order, contents, entries or books of the EPUB files below a path."""
    spark.dataSource.register(EpubSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("epub").option("rows", rows).options(**options).load(path)


def write_epub(pages: DataFrame, path: str) -> None:
    """A file <book_id>.epub for each book, from rows of book_id, title, pos, name, html. A book is built by one task, page by page."""
    rows = pages.select(F.col("book_id").cast("string").alias("book_id"), "title", F.col("pos").cast("long").alias("pos"), "name", "html")
    save(rows.repartition("book_id").sortWithinPartitions("book_id", "pos"), EpubSource, path)


def _base(name: str) -> str:
    return name.replace("\\", "/").rpartition("/")[2].lower()


class Directory:
    """Members of an archive by their path, by it with plain slashes and by its last part in any case; ties: the first."""

    def __init__(self, address: str):
        self.file = archive(address)
        self.by: list[dict[str, str]] = [{}, {}, {}]
        for z in self.file.infolist():
            for known, key in zip(self.by, self._keys(z.filename)):
                known.setdefault(key, z.filename)

    @staticmethod
    def _keys(path: str) -> tuple[str, str, str]:
        return path, path.replace("\\", "/"), _base(path)

    def find(self, path: str) -> str | None:
        return next((known[key] for known, key in zip(self.by, self._keys(path)) if key in known), None)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    address, directory, error = None, None, None
    for batch in batches:
        for book, path in zip(*(batch.column(c).to_pylist() for c in ("book_id", "path"))):
            if address != book:
                if directory:
                    directory.file.close()
                address, directory, error = book, None, None
                try:
                    directory = Directory(book)
                except (OSError, zipfile.BadZipFile) as e:
                    error = f"{type(e).__name__}: {e}"
            name, raw, own = None, None, error
            if directory and path is not None and (name := directory.find(path)) is not None:
                try:
                    raw = directory.file.read(name)
                except (zipfile.BadZipFile, zipfile.zlib.error, NotImplementedError, RuntimeError) as e:
                    own = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([pa.array([book], pa.string()), pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([raw], pa.binary()), pa.array([own], pa.string())], names=["book_id", "path", "name", "content", "error"])
    if directory:
        directory.file.close()


def read_members(wanted: DataFrame) -> DataFrame:
    """(book_id, path, name, content, error) for rows of book_id (an archive's address) and path: the bytes of the member of
    exactly that path, of it with plain slashes, or of its last part in any case; null if there is none. An archive's
    members are read together where rows allow it; one with many wanted members is the work of several tasks."""
    dealt = wanted.select("book_id", "path").repartition("book_id", "path").sortWithinPartitions("book_id", "path")
    return dealt.mapInArrow(_members, "book_id string, path string, name string, content binary, error string")
