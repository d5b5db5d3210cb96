"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The reader cuts archives into byte ranges. A task looks for the gzip magic inside its range, validates a candidate by
decoding the member's first bytes as a WARC header, and owns every record that starts inside; the last may end beyond.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import Stored, pick, scratch

MAGIC = b"\x1f\x8b\x08"
#: Namespace of record ids, which are made from the page id and the row's place among equal ones.
IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: What a record starts with.
VERSION = b"WARC/1."
#: Bytes read at a time.
STEP = 1 << 20
#: Digests of copied payloads up to which their table, some 100 bytes each, is sent to all tasks.
COPIED = 200_000


def record_id(page: int | None, digest: str, serial: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{page} {digest} {serial}')}>"


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, serial: str = "") -> bytes:
    """A WARC/1.1 record as a gzip member. Fields with the prefix WARC-X- are extensions, which readers may ignore.

    ``serial`` is empty for a response that others revisit, and makes the ids of all other records unique.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page, digest, serial)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,-./:;=?@[]_~")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-X-Payload-Length", str(len(payload))),
        ("WARC-X-Page", None if page is None else str(page)),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("WARC-X-Refers-To-Page", str(refers_to)),
        ]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def marked(pages: DataFrame, least_bytes: int = 100, salt: int = 32) -> DataFrame:
    """Pages with payload, payload_digest, record_type, refers_to and first (whether others may revisit it).

    Of pages with equal payloads of ``least_bytes`` or more, that with the smallest page_id is a response and the others
    revisit it; of repeated rows of that page_id one is, and the others revisit it too. Pages without an id revisit
    others, but are never revisited: where all pages of a payload lack one, all are responses. A null html is an empty
    payload; an empty table stays empty.

    Payloads aren't shuffled as long as the digests that occur twice or more are COPIED at most: these are sent to all
    tasks. Beyond, they are joined, each of them ``salt`` times, and pages of one digest are spread over that many keys.
    """
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    own = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.unhex("payload_digest").alias("key"), "page_id").agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("least"))
    copied = Stored(own.where("n > 1 and not least.none").select(F.lower(F.hex("key")).alias("payload_digest"), F.col("least.page_id").alias("first_id"), (F.col("least.n") > 1).alias("tied")))
    total, tied = copied.df.agg(F.count(F.lit(1)), F.count_if("tied")).first()
    if total <= COPIED:
        joined = rows.join(F.broadcast(copied.df), "payload_digest", "left")
    else:
        spread = copied.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salt)).cast("int")).join(spread, ["payload_digest", "salt"], "left")
    first = F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    joined = joined.select("page_id", "url", "payload", "payload_digest", "first_id", first.alias("first"), F.coalesce("tied", F.lit(False)).alias("tied"))
    if tied:  # repeated rows of a payload's smallest page_id are numbered by writing them once
        alike = Stored(joined.where(F.col("first") & F.col("tied")).withColumn("row", F.monotonically_increasing_id()))
        chosen = alike.df.groupBy("payload_digest").agg(F.min("row").alias("row"))
        chosen = F.broadcast(chosen) if tied <= COPIED else chosen
        one = alike.df.join(chosen.withColumn("chosen", F.lit(True)), ["payload_digest", "row"], "left").withColumn("first", F.coalesce("chosen", F.lit(False)))
        joined = joined.where(~(F.col("first") & F.col("tied"))).unionByName(one.select(*joined.columns))
    refers = F.when(~F.col("first"), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"), F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), "first")


def write(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) to archives in ``folder``, a URI that all executors reach.

    Returns path and records of each archive. A task writes under a name of its own and renames at the end, so a lost
    or repeated task leaves no half archive and no second one. A null html is an empty payload; null ids and urls leave
    their fields out; repeated rows get a record each, see ``marked``; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        own, n = f"{root}/_{context.partitionId():06d}-{context.taskAttemptId()}", 0
        out = None
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own, compression=None)
            for i in range(batch.num_rows):
                page, url, payload, digest, refers, kind, first = (batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "record_type", "first"))
                out.write(record(kind, page, url, payload, digest, refers, "" if first else f"{context.partitionId()}-{n}"))
                n += 1
        if out is not None:
            out.close()
            if store.get_file_info(name).type == fs.FileType.NotFound:
                store.move(own, name)
            else:  # another attempt at this task has ended before
                store.delete_file(own)
        yield pa.record_batch([pa.array([name] * bool(n), pa.string()), pa.array([n] * bool(n), pa.int64())], names=["path", "records"])

    return marked(pages, least_bytes).mapInArrow(run, "path string, records bigint")


class Window:
    """A file read front to back in steps: bytes are read once, whatever is decoded from them."""

    def __init__(self, source, size: int, step: int = STEP):
        self.source, self.size, self.step = source, size, step
        self.at, self.raw = 0, b""

    def from_(self, at: int) -> memoryview:
        """Bytes from ``at`` on, as many as are at hand, at least one; none at the end of the file."""
        if not self.at <= at < self.at + len(self.raw):
            self.source.seek(at)
            self.at, self.raw = at, self.source.read(min(self.step, self.size - at)) if at < self.size else b""
        return memoryview(self.raw)[at - self.at :]

    def magic(self, at: int, end: int) -> int:
        """Offset of the next gzip magic that starts in [at, end), or ``end``."""
        while at < end:
            part = bytes(self.from_(at))
            if (i := part.find(MAGIC)) >= 0:
                return min(at + i, end)
            # the last bytes may be the beginning of a magic; what follows tells
            for i in range(max(0, len(part) - len(MAGIC) + 1), len(part)):
                if MAGIC.startswith(part[i:]) and self.peek(at + i, len(MAGIC)) == MAGIC:
                    return min(at + i, end)
            at += len(part)
        return end

    def peek(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)


class Member:
    """Decodes one gzip member from ``at`` on, reading further as needed."""

    def __init__(self, window: Window, at: int):
        self.window, self.next = window, at
        self.unpack, self.out = zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Decodes some more; False at the end of the member or of the file."""
        if self.unpack.eof or self.next >= self.window.size:
            return False
        raw = self.window.from_(self.next)[: STEP // 16]
        self.next += len(raw)
        self.out += self.unpack.decompress(raw)
        if self.unpack.eof:
            self.next -= len(self.unpack.unused_data)
        return True

    def header(self) -> dict[str, str] | None:
        """The WARC header's fields, or None if no WARC record starts here. One that starts and breaks is an error."""
        seen = 0
        while (end := self.out.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.out)
            try:
                going = self.more()
            except zlib.error:
                going = False
            if not self.out[:7] == VERSION[: len(self.out[:7])]:
                return None
            if not going:
                if len(self.out) < len(VERSION):
                    return None
                raise ValueError("the header of a WARC record is damaged or cut short")
        if not self.out.startswith(VERSION):
            return None
        head = bytes(self.out[:end])
        self.body = end + 4
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}

    def block(self, length: int) -> bytes:
        while self.more():
            pass
        if not self.unpack.eof or len(self.out) < self.body + length:
            raise ValueError("a WARC record is cut short")
        return bytes(self.out[self.body : self.body + length])


def records(store: fs.FileSystem, path: str, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record that starts in [start, end).

    Members stand one after another. So where the file begins, and where a record ends, another has to start or the file
    to end; the range that a record starts in answers for the one that follows it, wherever that starts. Thereby a
    record that can't be found any more is an error, and isn't skipped.
    """
    with store.open_input_file(path) as source:
        window = Window(source, size)
        at = start if start == 0 else window.magic(start, end)
        follows = start == 0
        while at < end or follows and at < size:
            member = Member(window, at)
            try:
                head = member.header()
                if head is None and follows:
                    raise ValueError("no WARC record starts here")
                if at >= end:
                    return
                if head is not None:
                    yield at, head, member.block(int(head["content-length"]))
            except (ValueError, KeyError, zlib.error) as e:
                raise ValueError(f"{path} is damaged at byte {at}: {e}") from e
            follows = head is not None
            at = member.next if follows else window.magic(at + 1, end)


def read(spark: SparkSession, folder: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Records of all ``*.warc.gz`` archives of ``folder``, whoever wrote them.

    Returns path, start (byte offset), record_type, target_uri, page_id and refers_to (from our extension fields, else
    null), payload (the HTTP body; null for a revisit), payload_bytes and payload_digest. Response payloads are
    hashed again: one that differs from its header's SHA-256 fails the read, as does damage of any record, with its
    place. An empty or missing folder has no records. The driver lists the archives; the executors make the ranges.
    """
    store, root = fs.FileSystem.from_uri(folder)
    found = [(f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.path.endswith(".warc.gz") and f.size]
    tasks = sum(-(-size // split_bytes) for _, size in found)
    splits = spark.createDataFrame(found, "path string, size bigint").select("path", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("start"), "size")
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, "size")).repartition(max(1, min(tasks, 100_000)))
    schema = "path string, start bigint, record_type string, target_uri string, page_id bigint, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, _ = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for split in batch.to_pylist():
                for at, head, block in records(reach, split["path"], split["start"], split["end"], split["size"]):
                    payload, length = None, head.get("warc-x-payload-length")
                    digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if head.get("warc-type") != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                        own, length = hashlib.sha256(payload).hexdigest(), len(payload)
                        if digest and re.fullmatch("[0-9a-f]{64}", digest) and digest != own:
                            raise ValueError(f"the payload at {at} of {split['path']} differs from its digest")
                        digest = own
                    number = lambda k: int(v) if (v := head.get(k)) is not None else None
                    rows.append((split["path"], at, head.get("warc-type"), head.get("warc-target-uri"), number("warc-x-page"), number("warc-x-refers-to-page"), payload, None if length is None else int(length), digest))
                    held += len(block)
                    if held > 4 * STEP:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
        yield _batch(rows, names, types)

    return splits.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back, as ``read`` gives them.

    A row for each row of ``pages``: null texts are empty payloads, null ids stay null, repeated rows and equal payloads
    are told apart as by ``marked``, an empty table gives none. A task holds a payload at a time, whatever its length.
    """
    spark = pages.sparkSession
    folder = scratch(spark)
    if "://" not in folder:
        folder = folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"
    write(pages, folder, least_bytes).write.format("noop").mode("overwrite").save()
    return read(spark, folder)
