"""Results as files: one for each page, or lines, written whole or not at all.

Each attempt of a task writes into a folder of its own beside the target; the commit moves the folders of the attempts
that succeeded into their places and drops the others, so a task that is killed leaves nothing that can be read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom.sources.places import opened

FORMS = ("files", "lines")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    task: int
    rows: int


class _Sink:
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.form, self.overwrite = options["path"].rstrip("/"), options.get("form", "lines"), overwrite
        self.suffix = options.get("suffix", ".md" if self.form == "files" else ".jsonl")
        if self.form not in FORMS:
            raise ValueError(f"form must be one of {FORMS}")
        needed = ["name", "content"] if self.form == "files" else ["value"]
        if missing := [n for n in needed if n not in schema.fieldNames()]:
            raise ValueError(f"form {self.form} needs the columns {missing}")
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        folder = f"{root}/{self.pending}/{task}-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        many = 0
        if self.form == "files":
            for r in rows:
                name = quote(str(r["name"]), safe=" ()+,;=@_-.")[:200].lstrip(".") or f"row {many}"
                with store.open_output_stream(f"{folder}/{name}{self.suffix}") as out:
                    out.write((r["content"] or "").encode("utf-8", "surrogatepass"))
                many += 1
        else:
            with store.open_output_stream(f"{folder}/lines{self.suffix}") as out:
                for r in rows:
                    if r["value"] is not None:
                        out.write(re.sub(r"[\r\n]+", " ", r["value"]).encode("utf-8", "surrogatepass") + b"\n")
                        many += 1
        return Written(folder, task, many)

    def _place(self, messages: list[Written | None], target: str, replace: bool) -> None:
        """Moves what succeeded to ``target``: a folder for each task, or a file for each where they are lines."""
        store, root = opened(self.path)
        if replace and store.get_file_info(target).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(target)):
                if not f.base_name.startswith("_pending-"):
                    (store.delete_dir if f.type == fs.FileType.Directory else store.delete_file)(f.path)
        store.create_dir(target, recursive=True)
        mark = "" if replace else f"-{self.pending[9:17]}"
        for m in messages:
            if m is not None and m.rows:
                if self.form == "lines":
                    store.move(f"{m.folder}/lines{self.suffix}", f"{target}/part-{m.task:05d}{mark}{self.suffix}")
                else:
                    store.move(m.folder, f"{target}/part-{m.task:05d}{mark}")
        self._drop()

    def _drop(self) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.pending}")


class SinkWriter(_Sink, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._place(messages, opened(self.path)[1], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()


class SinkStreamWriter(_Sink, DataSourceStreamWriter):
    """Each batch in a folder of its own, which the same batch replaces if it is written again after a restart."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._place(messages, f"{opened(self.path)[1]}/batch-{batchId:08d}", True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop()


class ResultSink(DataSource):
    """``df.write.format("webloom_files")``, for batches and streams, with option path and

    form ``lines`` (column value, a line each, line ends inside as blanks) or ``files`` (columns name and content, a file
    each; names of a task must differ); suffix of the files. Null values give no line; null contents empty files.
    """

    @classmethod
    def name(cls) -> str:
        return "webloom_files"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SinkWriter(self._options(), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return SinkStreamWriter(self._options(), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResultSink)
