"""The activity log as a stream: files of a month grow at their ends, and an offset says how far each has been read."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from folio.sources.logs import LINE
from folio.sources.stores import listing, store

#: A task reads about so many bytes of a file.
RANGE = 16 << 20
_LINE = re.compile(LINE)


class Part(InputPartition):
    """Bytes of one file."""

    def __init__(self, address: str, begin: int, end: int):
        self.address, self.begin, self.end = address, begin, end


class ActivityReader(DataSourceStreamReader):
    """Offsets are bytes read of each file, by its address below the path."""

    def __init__(self, path: str, extension: str, size: int):
        self.path, self.extension, self.size = path, extension, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {address: self._whole_lines(address, size) for address, size in listing(self.path, self.extension)}

    @staticmethod
    def _whole_lines(address: str, size: int) -> int:
        """Where the last whole line of the first `size` bytes ends: a line that is still being written stays for later."""
        files, path, _ = store(address)
        with files.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(0, end - 4096)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for address, upto in sorted(end.items()):
            begin = start.get(address, 0)
            while begin < upto:
                out.append(Part(address, begin, min(begin + self.size, upto)))
                begin += self.size
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        """Lines that begin in the partition's bytes."""
        files, path, _ = store(partition.address)
        with files.open_input_file(path) as f:
            f.seek(max(0, partition.begin - 1))
            raw = f.read(partition.end - max(0, partition.begin - 1))
            while raw and not raw.endswith(b"\n") and (more := f.read(4096)):
                cut = more.find(b"\n")
                raw += more if cut < 0 else more[: cut + 1]
        first = 0 if partition.begin == 0 else raw.find(b"\n", 0) + 1
        if partition.begin and not first:
            return
        for line in raw[first:].decode("utf-8", "replace").split("\n"):
            if m := _LINE.match(line.rstrip("\r")):
                try:
                    ts = datetime.strptime(m[2], "%Y-%m-%d %H:%M:%S")
                except ValueError:
                    ts = None
                yield m[1], ts, m[3], m[4]

    def commit(self, end: dict) -> None:
        pass


class ActivityLog(DataSource):
    """spark.readStream.format("activity_log").load(path): session_id, ts, filename, operation of each line once. Lines of another
    form are passed over; `extension` says which files are logs, `range` how many bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "activity_log"

    def schema(self) -> str:
        return "session_id string, ts timestamp, filename string, operation string"

    def streamReader(self, schema) -> ActivityReader:
        return ActivityReader(self.options.get("path"), self.options.get("extension", ".log"), int(self.options.get("range", RANGE)))


def stream_activity(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(ActivityLog)
    return spark.readStream.format("activity_log").options(**options).load(path)
