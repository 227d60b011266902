"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

An archive is a folder of files, each a row of gzip members with one record per member. A member's
gzip head has the ``sl`` field of the format's annex (compressed and plain length), so a reader that has
parsed a record's headers and does not want it goes on at the next member without inflating the payload.
Files of other writers, plain or gzip, with or without that field, are read as well.

Reading: whole files are dealt to partitions by size. Predicates on header columns (``HEADER_COLUMNS``)
are pushed into the source, which tests them on the parsed headers. Option ``payload`` = ``false`` leaves
all payloads undecoded (column null). Writing: files roll at ``file_bytes``; those of finished tasks
are listed in a manifest on commit, so what a lost or repeated task has left behind is never read.
"""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardwatch.llm.common import quoted, text_of
from cardwatch.operators.groups import join_stats
from cardwatch.session import scratch_path

SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, "
          "payload_digest string, content_type string, block_bytes bigint, headers map<string,string>, payload binary")
#: Columns that are known before a payload is touched: predicates on them are pushed down.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "content_type",
                  "block_bytes")
#: Headers that have a column of their own.
_FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
           "content_type": "content-type"}
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Longest head of a record, bytes read at a time, bytes of payload in a batch sent to Spark.
MOST_HEAD, READ, BATCH_BYTES = 1 << 20, 1 << 18, 4 << 20
FILE_BYTES, PARTITION_BYTES = 256 << 20, 128 << 20


def filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


# Writing


def _value(text: str) -> str:
    """A header value on one line: controls and blanks at its ends would break the head."""
    return re.sub(r"[\x00-\x1f\x7f]|^ | $", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as one gzip member with its lengths in the gzip head."""
    lines = [VERSION, *(f"{k}: {_value(v)}".encode() for k, v in headers), b"Content-Length: %d" % len(block), b"", b""]
    plain = b"\r\n".join(lines) + block + b"\r\n\r\n"
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    deflated = body.compress(plain) + body.flush()
    tail = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    whole = 24 + len(deflated) + len(tail)
    known = whole < 1 << 32 and len(plain) < 1 << 32
    lengths = struct.pack("<II", whole, len(plain)) if known else bytes(8)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sH", 12, b"sl", 8) + lengths + deflated + tail


def digest_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def digest_hex(label: str | None) -> str | None:
    """The digest of a ``sha1:`` label (base 32 or hex) in lower-case hex; other labels as they are."""
    if label is None or not label.lower().startswith("sha1:"):
        return label
    value = label[5:]
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def record_of(row: dict, now: str) -> bytes:
    """One row of the columns to write as a record.

    A ``response`` holds an HTTP head and the payload, a ``revisit`` the HTTP head only, other types the
    payload itself. Null payloads count as empty. ``headers`` adds further named fields.
    """
    kind = row.get("record_type") or "resource"
    payload = bytes(row.get("payload") or b"")
    digest = row.get("payload_digest")
    label = digest_label(bytes.fromhex(digest)) if digest and re.fullmatch("[0-9a-f]{40}", digest) else digest
    if label is None:
        label = digest_label(hashlib.sha1(payload).digest())
    named = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>"),
             ("WARC-Date", row.get("date") or now)]
    if row.get("target_uri") is not None:
        named.append(("WARC-Target-URI", row["target_uri"]))
    if row.get("refers_to") is not None:
        named.append(("WARC-Refers-To", row["refers_to"]))
    if kind == "revisit":
        named.append(("WARC-Profile", REVISIT))
    named.append(("WARC-Payload-Digest", label))
    own = row.get("headers") or {}
    named += own.items() if isinstance(own, dict) else own
    if kind in ("response", "revisit"):
        named.append(("Content-Type", "application/http; msgtype=response"))
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        block = head + (b"\r\n" if kind == "revisit" else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    else:
        named.append(("Content-Type", row.get("content_type") or "application/octet-stream"))
        block = payload
    return encode_record(named, block)


@dataclasses.dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = filesystem(self.path)
        files.create_dir(folder, recursive=True)
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                columns = {n: batch.column(n) for n in batch.schema.names}
                for k in range(batch.num_rows):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = files.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                ("WARC-Date", now), ("WARC-Filename", names[-1]),
                                ("Content-Type", "application/warc-fields")]
                        size = out.write(encode_record(info, b"format: WARC File Format 1.1\r\n"))
                    size += out.write(record_of({n: c[k].as_py() for n, c in columns.items()}, now))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        files, folder = filesystem(self.path)
        files.create_dir(folder, recursive=True)
        old = manifests(files, folder) if self.overwrite else []
        name = f"{folder}/_manifest-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{name}.tmp", compression=None) as out:
            out.write(json.dumps([n for m in messages if m for n in m.files]).encode())
        gone = [f"{folder}/{n}" for m in old for n in listed(files, m)]
        files.move(f"{name}.tmp", f"{name}.json")
        for path in [*old, *gone]:
            files.delete_file(path)

    def abort(self, messages: list) -> None:
        files, folder = filesystem(self.path)
        for name in (n for m in messages if m for n in m.files):
            files.delete_file(f"{folder}/{name}")


# Reading


def manifests(files: pa.fs.FileSystem, folder: str) -> list[str]:
    found = files.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if re.fullmatch(r"_manifest-\w+\.json", f.base_name))


def listed(files: pa.fs.FileSystem, manifest: str) -> list[str]:
    with files.open_input_stream(manifest, compression=None) as data:
        return json.loads(data.read())


def archive_files(files: pa.fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of an archive: the files of its manifests, else all ``.warc`` and ``.warc.gz`` below."""
    if files.get_file_info(path).type == pa.fs.FileType.File:
        return [(path, files.get_file_info(path).size)]
    held = manifests(files, path)
    if held:
        names = [f"{path}/{n}" for m in held for n in listed(files, m)]
        return [(f.path, f.size) for f in files.get_file_info(names)] if names else []
    found = files.get_file_info(pa.fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.base_name))


class Source:
    """Bytes of a file by position; a jump past what is held reads nothing in between."""

    def __init__(self, file):
        self.file, self.size, self.base, self.held = file, file.size(), 0, b""
        self.read_bytes = 0

    def at(self, place: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``place``; fewer only at the end of the file."""
        if not (self.base <= place and place + n <= self.base + len(self.held)):
            self.file.seek(place)
            self.base, self.held = place, self.file.read(max(n, min(READ, self.size - place)))
            self.read_bytes += len(self.held)
        return self.held[place - self.base:place - self.base + n]


class Plain:
    """The bytes of an uncompressed record, read on from ``place``."""

    def __init__(self, source: Source, place: int):
        self.source, self.start, self.place = source, place, place

    def more(self, most: int) -> bytes:
        data = self.source.at(self.place, most)
        self.place += len(data)
        return data

    def after(self, plain: int) -> int:
        """The place of the next record, ``plain`` bytes from this one's start."""
        return self.start + plain


class Member:
    """The bytes of a gzip member, inflated only as far as they are asked for."""

    def __init__(self, source: Source, place: int):
        self.source, self.start, self.place = source, place, place
        self.zip = zlib.decompressobj(31)
        head = source.at(place, 12)
        self.length = 0
        if head[3:4] == b"\x04":
            extra = source.at(place + 12, struct.unpack("<H", head[10:12])[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n:]

    def more(self, most: int) -> bytes:
        while not self.zip.eof:
            data = self.zip.unconsumed_tail or self.source.at(self.place, min(READ, 1 << 16))
            if not self.zip.unconsumed_tail:
                self.place += len(data)
                if not data:
                    raise ValueError("the file ends inside a record")
            out = self.zip.decompress(data, most)
            if out:
                return out
        return b""

    def after(self, plain: int) -> int:
        if self.length:
            return self.start + self.length
        while not self.zip.eof:
            self.more(1 << 20)
        return self.place - len(self.zip.unused_data)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    found: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            found[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP head of an HTTP record; else the whole block."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(file, wanted, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of a file that ``wanted(headers)`` accepts.

    Headers are parsed first. The rest of a record that isn't wanted is jumped over; it is read only
    where a gzip member does not say its length.
    """
    source, place = Source(file), 0
    while place < source.size:
        lead = source.at(place, 2)
        if lead in (b"\r\n", b"\n", b"\r", b"\n\n"):  # blank lines between records
            place += 1
            continue
        body = Member(source, place) if lead == b"\x1f\x8b" else Plain(source, place)
        held = b""
        while (end := held.find(b"\r\n\r\n")) < 0:
            data = body.more(4096)
            if not data or len(held) > MOST_HEAD:
                raise ValueError(f"no record head at byte {place}")
            held += data
        headers = parse_head(held[:end])
        size = int(headers["content-length"])
        want = wanted(headers)
        if want and payload:
            parts = [held[end + 4:end + 4 + size]]
            got = len(parts[0])
            while got < size:
                data = body.more(min(size - got, 1 << 20))
                if not data:
                    raise ValueError(f"the record at byte {place} ends early")
                parts.append(data[:size - got])
                got += len(parts[-1])
            yield headers, payload_of(headers, b"".join(parts))
        elif want:
            yield headers, None
        place = body.after(end + 4 + size + 4)


def column_of(headers: dict[str, str], name: str):
    if name == "block_bytes":
        return int(headers["content-length"])
    value = headers.get(_FIELDS[name])
    return digest_hex(value) if name == "payload_digest" else value


#: Predicates that can be told from headers alone: how each tests a value.
_TESTS = {
    ds.EqualTo: lambda v, f: v is not None and v == f.value,
    ds.EqualNullSafe: lambda v, f: v == f.value,
    ds.In: lambda v, f: v is not None and v in f.value,
    ds.GreaterThan: lambda v, f: v is not None and v > f.value,
    ds.GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    ds.LessThan: lambda v, f: v is not None and v < f.value,
    ds.LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    ds.IsNull: lambda v, f: v is None,
    ds.IsNotNull: lambda v, f: v is not None,
    ds.StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    ds.StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    ds.StringContains: lambda v, f: v is not None and f.value in v,
}
#: Orders of strings are left to Spark, which compares UTF-8 bytes.
_ORDERS = (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


def pushable(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):  # exact where a missing value can't turn into a match
        return isinstance(f.child, (ds.IsNull, ds.IsNotNull)) and pushable(f.child)
    if type(f) not in _TESTS or len(f.attribute) != 1 or f.attribute[0] not in HEADER_COLUMNS:
        return False
    return not isinstance(f, _ORDERS) or f.attribute[0] == "block_bytes"


def passes(headers: dict[str, str], f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return not passes(headers, f.child)
    return _TESTS[type(f)](column_of(headers, f.attribute[0]), f)


class Files(ds.InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files dealt out by size, in order of their names."""
        files, folder = filesystem(self.path)
        out, held, size = [], [], 0
        for path, n in archive_files(files, folder):
            if held and size + n > self.partition_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        schema = pa.schema([(n, pa.string()) for n in names[:7]] + [
            ("block_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.value:
            with files.open_input_file(path) as file:
                for headers, payload in records(file, lambda h: all(passes(h, f) for f in self.filters), self.payload):
                    rows.append([*(column_of(headers, n) for n in names[:8]), list(headers.items()), payload])
                    size += 1024 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


class WarcSource(ds.DataSource):
    """Read and append archives: option ``path``, and those named above."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to a session and let Spark push predicates into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True, **options) -> DataFrame:
    """The records of an archive, a folder or a file. An empty archive gives no rows."""
    register(spark)
    return spark.read.format("warc").options(path=path, payload=str(payload).lower(), **options).load()


def write_warc(rows: DataFrame, path: str, **options) -> None:
    """Append records to an archive. Columns that are read: record_id, record_type, target_uri, date, refers_to,
    payload_digest, content_type, headers and payload; any of them may be missing, and further ones are left out."""
    register(rows.sparkSession)
    known = [n for n in (x.split()[0] for x in SCHEMA.split(", ")) if n != "block_bytes" and n in rows.columns]
    rows.select(*known).write.format("warc").options(path=path, **options).mode("append").save()


# Pages with equal payloads

LEAST_REVISIT = 1000


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_REVISIT) -> DataFrame:
    """The records of a table of pages: of those with equal payloads of ``least`` bytes or more, the one with
    the largest id is a response with the payload, the others are revisits that refer to it.

    Null html counts as empty. Rows that repeat the largest id of a payload are each a response; a missing id is
    smaller than any other, and where all ids of a payload are missing, each is a response. A missing url
    gives a record without one; columns other than the three named are not read. An empty table has no records.
    """
    payload = F.to_binary(text_of(html_col), F.lit("utf-8"))
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("target_uri"),
                        payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("same"), F.octet_length("payload").cast("long").alias("n"))
    groups = rows.where(F.col("n") >= least).groupBy("same").agg(
        F.max("id").alias("first_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    joined = join_stats(rows, groups, "same")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select(
        F.when(F.col("id").isNotNull(), record_id("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, record_id("first_id")).alias("refers_to"), F.sha1("payload").alias("payload_digest"),
        F.create_map(F.lit("X-Payload-Length"), F.col("n").cast("string")).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def record_id(column: str):
    return F.concat(F.lit("<urn:page:"), F.col(column).cast("string"), F.lit(">"))


def page_of(column: str, kind):
    """The id inside a record's id; null where the record was written without one."""
    return F.regexp_extract(column, "^<urn:page:(.*)>$", 1).try_cast(kind)


def archive_report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as an archive and report each page as the archive has it (see :func:`page_records`).

    Responses are read with their payloads, whose length and digest are taken anew; revisits are read by headers
    alone, their length and digest from there. Both choose their records by a predicate that is pushed down.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = path or scratch_path(spark, "warc")
    write_warc(page_records(pages), path)
    full = read_warc(spark, path).where(F.col("record_type") == "response").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit").select(
        "record_id", F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to")
    return full.unionByName(again).select(
        page_of("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to", kind).alias("refers_to"))

