"""Lines as a stream: a file, or a folder of files, to which lines are appended.

Offsets are bytes of each file, so a query that is started again from its checkpoint goes on behind the last line it
answered. What is behind the last line end waits until the line ends.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webloom.sources.places import opened

SCHEMA = StructType([StructField("file", StringType()), StructField("at", LongType()), StructField("value", StringType())])
#: Bytes of a partition, about.
PART = 4 << 20


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Lines:
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partbytes", PART))

    def _files(self) -> dict[str, int]:
        """Bytes of each file."""
        store, root = opened(self.path)
        at = store.get_file_info(root)
        found = store.get_file_info(fs.FileSelector(root)) if at.type == fs.FileType.Directory else [at]
        return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def _whole(self, file: str, start: int, end: int) -> int:
        """The end of the last whole line between two places."""
        store, _ = opened(self.path)
        with store.open_input_file(file) as f:
            while end > start:
                a = max(start, end - 65536)
                f.seek(a)
                cut = f.read(end - a).rfind(b"\n")
                if cut >= 0:
                    return a + cut + 1
                end = a
        return start

    def _ranges(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, a, min(a + self.part, n)) for f, n in sorted(end.items()) for a in range(start.get(f, 0), n, self.part)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that start in the range; the last one may end behind it."""
        store, _ = opened(self.path)
        with io.BufferedReader(store.open_input_file(partition.file)) as f:
            at = partition.start
            if at > 0:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # to the first line that starts here, which is at once one behind a line end
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                yield partition.file.rsplit("/", 1)[-1], at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)


class LineStreamReader(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: self._whole(f, 0, n) for f, n in self._files().items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self._ranges(start, end)

    def commit(self, end: dict) -> None:
        pass


class LineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self._ranges({}, self._files())


class LineSource(DataSource):
    """``spark.readStream.format("webloom_lines").load(path)``: file, at (the byte it starts at), value, for batches too."""

    @classmethod
    def name(cls) -> str:
        return "webloom_lines"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LineReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LineStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineSource)
