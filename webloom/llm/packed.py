"""Arrays of numbers as bytes, so that a shuffle moves few large rows instead of many small ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CODEC = pa.Codec("zstd", 1)


def pack(x: np.ndarray) -> bytes:
    """An array of whole numbers or floats as bytes. Neighbours that are close, as in sorted arrays, take little room."""
    if x.dtype.kind in "iu" and len(x):
        with np.errstate(over="ignore"):
            x = np.diff(x, prepend=x.dtype.type(0))
    body = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(body).to_bytes(8, "little") + CODEC.compress(body, asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(raw[:8], "little")
    body = np.frombuffer(CODEC.decompress(raw[8:], n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    x = np.ascontiguousarray(body.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if kind.kind in "iu" else x


def by_part(part: np.ndarray, columns: dict[str, np.ndarray], **constant: int) -> Iterator[pa.RecordBatch]:
    """A row (part, the constants as int, the packed columns) for each part that has elements; their order inside stays."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(1, np.int64)
    sorted_ = {k: v[order] for k, v in columns.items()}
    rows = {k: [pack(v[a:b]) for a, b in zip(cuts, cuts[1:])] for k, v in sorted_.items()}
    n = len(cuts) - 1
    yield pa.record_batch(
        [pa.array(part[cuts[:-1]].astype(np.int32)), *[pa.array([v] * n, pa.int32()) for v in constant.values()], *[pa.array(v, pa.binary()) for v in rows.values()]],
        names=["part", *constant, *rows],
    )


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, sorted, with the sums of their ``n``."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.diff(code, prepend=code[0] - 1)) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.add.reduceat(n[order], starts) if len(starts) else n[:0]


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Part p as partition p."""
    return df.repartitionById(parts, df["part"])


def in_turns(df: DataFrame, columns: dict[str, type], constants: tuple[str, ...], part_of: Callable[..., np.ndarray], parts: int, partitions: int, most: int) -> DataFrame:
    """Part p of ``parts`` in partition p mod ``partitions``, where the rows of a part stand together, one part after another.

    ``df`` has the rows of ``by_part`` for p mod ``partitions``; ``part_of(columns, *constants)`` gives p for each element. Where
    a partition has several parts, what it gets is dealt to them ``most`` elements at a time and sorted, which spills; so
    neither the shuffle's rows nor what ``turns`` holds depends on the number of parts.
    """
    if parts <= partitions:
        return dealt(df, parts)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[dict[str, np.ndarray]]] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for constant, found in held.items():
                joined = {c: np.concatenate([x[c] for x in found]) for c in columns}
                yield from by_part(part_of(joined, *constant), joined, **dict(zip(constants, constant)))
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                found = {c: unpack(batch.column(c)[i].as_py(), kind) for c, kind in columns.items()}
                held.setdefault(tuple(batch.column(c)[i].as_py() for c in constants), []).append(found)
                n += len(found[next(iter(columns))])
                if n > most:
                    yield from out()
                    n = 0
        yield from out()

    names = ["part", *constants, *columns]
    return dealt(df.select(*names), partitions).mapInArrow(split, df.select(*names).schema).sortWithinPartitions("part")


def turns(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a partition of ``in_turns``, those of one part at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist() if len(part) else []
        for a, b in zip(cuts, cuts[1:]):
            if held and part[a] != now:
                yield held
                held = []
            now = part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def gathered(batches: Iterable[pa.RecordBatch], kinds: dict[str, type], where: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """The columns of all rows of a partition, unpacked and joined; ``where`` names constants that rows must have."""
    found: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        good = np.ones(batch.num_rows, bool)
        for name, value in (where or {}).items():
            good &= batch.column(name).to_numpy() == value
        for i in np.flatnonzero(good).tolist():
            for name, kind in kinds.items():
                found[name].append(unpack(batch.column(name)[i].as_py(), kind))
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in found.items()}


def pieces(batches: Iterable[pa.RecordBatch], kinds: dict[str, type], most: int, where: dict[str, int] | None = None) -> Iterator[dict[str, np.ndarray]]:
    """What ``gathered`` returns, in pieces that end as soon as they have more than ``most`` elements."""
    held: list[pa.RecordBatch] = []
    n = 0
    first = next(iter(kinds))
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(batch.slice(i, 1))
            n += int.from_bytes(batch.column(first)[i].as_py()[:8], "little") // np.dtype(kinds[first]).itemsize
            if n > most:
                yield gathered(held, kinds, where)
                held, n = [], 0
    if held:
        yield gathered(held, kinds, where)
