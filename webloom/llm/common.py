"""What the operators of this subpackage share: column picking, shared tables, byte-sized chunks."""

from __future__ import annotations

import atexit
import pickle
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.sources.layout import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by position, so that other columns may have any name (a repeated one too)."""
    columns = df.columns
    for name in names:
        if name not in columns:
            raise ValueError(f"there is no column {name!r} among {columns}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"_c{columns.index(n)}").alias(n) for n in names])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_left: dict[str, SparkSession] = {}
#: Paths made since the innermost ``settled`` began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@atexit.register
def _clear() -> None:
    for path, spark in list(_left.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended: its owner clears the shared folder
            pass


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; removed when the driver ends, or by ``forget``."""
    path = f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}"
    _left[path] = spark
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    if _left.pop(path, None) is not None:
        _delete(spark, path)


class Stored:
    """A DataFrame written to the shared folder and read again.

    This cuts the lineage: what is read later doesn't depend on any executor that wrote it.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = scratch(self.spark)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        forget(self.spark, self.path)


def stretches(batches: Iterable[pa.RecordBatch], size: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, as told by column ``size``, however large the given ones are."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = [n or 0 for n in batch.column(size).to_pylist()]
        for a, b in chunks(sizes, most):
            own = sum(sizes[a:b])
            if held and total + own > most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, total = [], 0
            held.append(batch.slice(a, b - a))
            total += own
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; all tables that were written on the way to it are removed."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
    finally:
        _made.reset(token)
    out = Stored(df)
    for path in made:
        forget(out.spark, path)
    return out.df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of an Arrow batch for whole texts, unless the session has a number of its own: the default of 10,000 can be a whole partition."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


#: How to let go of what the functions of this subpackage keep in a Python worker from one task to the next.
kept: list[Callable[[], None]] = []


def release() -> None:
    """Lets go of it: at the start of a task that needs memory for other things, since workers are used again."""
    for clear in kept:
        clear()
    pa.default_memory_pool().release_unused()


#: What a process of ``apart`` runs: a call from standard input, rows after it, its result to standard output.
_CALL = """
import importlib, pickle, sys
sys.path[:], module, name, args, options = pickle.load(sys.stdin.buffer)
rows = []
while (row := pickle.load(sys.stdin.buffer)) is not None:
    rows.append(row)
given = [rows] if options.pop("rows", None) else []
sys.stdout.buffer.write(pickle.dumps(getattr(importlib.import_module(module), name)(*given, *args, **options)))
"""


def apart(make: Callable[..., object], *args, rows: Iterable[object] | None = None, **options) -> object:
    """The result of a function of a module, run by a process of its own, which takes its memory along when it ends.

    ``rows`` come to it as a list before ``args``. They are handed on one by one, so only that process ever holds all of them;
    none may be None. What it writes to standard error goes to a file meanwhile, as a full pipe would stop it.
    """
    with tempfile.TemporaryFile() as errors, subprocess.Popen([sys.executable, "-c", _CALL], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors) as process:
        try:
            told = options | ({} if rows is None else {"rows": True})
            pickle.dump((sys.path, make.__module__, make.__qualname__, args, told), process.stdin)
            for row in rows or ():
                pickle.dump(row, process.stdin)
            pickle.dump(None, process.stdin)
            process.stdin.close()
        except BrokenPipeError:  # it has failed: its own words say why
            pass
        except BaseException:
            process.kill()
            raise
        made = process.stdout.read()
        if process.wait():
            errors.seek(0)
            raise RuntimeError(f"{make.__qualname__} failed: {errors.read().decode(errors='replace')[-1000:]}")
    return pickle.loads(made)


def few(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """``rows`` of up to four numbers, to be sent to all tasks if there are ``most`` at most (some 50 MB as a hash table); then what they are joined with isn't shuffled."""
    return F.broadcast(rows) if rows.count() <= most else rows


def chunks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with ``most`` in total at most, or a single one that is larger."""
    start = total = end = 0
    for end, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield start, end - 1
            start, total = end - 1, 0
        total += n
    if end > start:
        yield start, end
