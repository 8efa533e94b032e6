"""Files for Python data sources, in any store that Arrow's file systems reach (local, HDFS, S3, GCS, ABFS)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceWriter, WriterCommitMessage


def store(address: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path and what stands before the path in addresses of this store. Plain paths are local."""
    if address.startswith("file:"):
        address = "/" + address[5:].lstrip("/")
    if "://" not in address:
        return fs.LocalFileSystem(), address, "file:"
    files, path = fs.FileSystem.from_uri(address.rstrip("/"))
    return files, path, address[: address.rindex(path)]


def listing(address: str, extension: str) -> list[tuple[str, int]]:
    """Addresses and sizes of the files below an address (or of that file), sorted."""
    files, path, before = store(address)
    info = files.get_file_info(path)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/") if x)
    return sorted((before + f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(extension) and not hidden(f.path))


class Staged(WriterCommitMessage):
    """Files that a task has written: (staged path, path)."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class StagedWriter(DataSourceWriter):
    """Tasks write into a staging folder; the commit moves their files to their names, an abort deletes the folder.

    A task that is run again or twice stages files of its own, and only those of the one that Spark commits are moved.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def files_of(self, rows: Iterable) -> Iterator[tuple[str, Iterable[bytes]]]:
        """Names below the path, and the parts of each file, from a task's rows."""
        raise NotImplementedError

    def write(self, iterator) -> Staged:
        files, root, _ = store(self.staging)
        files.create_dir(own := f"{root}/{uuid.uuid4().hex}", recursive=True)
        out = []
        for name, parts in self.files_of(iterator):
            place = f"{own}/{len(out)}"
            with files.open_output_stream(place) as sink:
                for part in parts:
                    sink.write(part)
            out.append((place, name))
        return Staged(out)

    def commit(self, messages) -> None:
        files, root, _ = store(self.path)
        names = [name for m in messages if m for _, name in m.files]
        if len(set(names)) < len(names):
            twice = sorted({n for n in names if names.count(n) > 1})[:3] if len(names) < 10_000 else ""
            raise ValueError(f"several files would have the same name {twice}")
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if not f.base_name.startswith("_staging-"):
                    (files.delete_file if f.is_file else files.delete_dir)(f.path)
        elif taken := [n for n in names if files.get_file_info(f"{root}/{n}").type != fs.FileType.NotFound]:
            raise FileExistsError(f"already there: {self.path}/{taken[0]}")
        for folder in {n.rpartition("/")[0] for n in names}:
            files.create_dir(f"{root}/{folder}", recursive=True)
        for m in messages:
            for place, name in m.files if m else ():
                files.move(place, f"{root}/{name}")
        files.delete_dir(store(self.staging)[1])

    def abort(self, messages) -> None:
        files, root, _ = store(self.staging)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)


def save(rows: DataFrame, source, path: str, mode: str = "overwrite", **options: str) -> None:
    """Writes rows by a Python data source class."""
    rows.sparkSession.dataSource.register(source)
    rows.write.format(source.name()).mode(mode).options(**options).save(path)


def arrays(schema, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a source as an Arrow batch of its schema."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
