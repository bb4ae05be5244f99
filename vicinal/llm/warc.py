"""WARC archives as a data source of Spark, written in Python.

``spark.read.format("warc").load(folder)`` plans one partition per file, reads headers first
and skips payloads that nobody asked for: filters on record_type, record_id, target_uri,
payload_digest, refers_to and content_length are taken over by the reader and tested before a
payload is touched, and with the option ``payload`` set to false no payload is read at all.
Files are read through Arrow's file systems. Archives written here are one gzip member per
record with its length in the member's ``sl`` extra field, so a skipped record costs a seek;
other gzip files are inflated through, and plain ``.warc`` files are seeked over.

``df.write.format("warc").mode("append").save(folder)`` writes a file per task under a name of its own; the
commit writes a list of the committed files, so files of lost or repeated tasks are not read.
The writer needs a folder that all machines share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, page_id string, payload_length long, payload binary"
# Header names of the WARC standard, and two of our own that begin with X-.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-Id",
    "payload_length": "X-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # Fixed value.
LIST_NAME = "_committed"
_BLOCK = 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


# -- records ----------------------------------------------------------------------------------
def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One record: version line, headers, block, two line ends."""
    lines = ["WARC/1.1", *(f"{HEADERS[k]}: {_clean(v)}" for k, v in fields.items() if v is not None)]
    if fields.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def member(raw: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the inflated length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8 & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined."""
    found, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


class _Plain:
    """Bytes of an uncompressed archive: what is skipped is seeked over, not read."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def _more(self) -> bool:
        data = self.file.read(_BLOCK)
        self.held += data
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the archive."""
        while True:
            self.held = self.held.lstrip(b"\r\n")  # what is left of the record before
            if self.held or not self._more():
                break
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held:
                    raise ValueError("an archive ends within a header")
                return None
        head, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return head

    def read(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held = self.held[n:]
        while have < n and self._more():
            parts.append(self.held[: n - have])
            self.held = self.held[n - have :]
            have += len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        over = n - len(self.held)
        self.held = self.held[n:]
        if over > 0:
            self.file.seek(self.file.tell() + over)


class _Gzip(_Plain):
    """Bytes of a gzip archive, inflated as far as they are asked for."""

    def __init__(self, file):
        super().__init__(file)
        self.packed, self.inflater, self.after = b"", None, None

    def _more(self) -> bool:
        if self.inflater is None or self.inflater.eof:
            if self.inflater is not None:
                self.packed = self.inflater.unused_data
            while len(self.packed) < 24 and (more := self.file.read(_BLOCK)):
                self.packed += more
            if not self.packed:
                return False
            self.after = None
            if self.packed[:2] == b"\x1f\x8b" and self.packed[3] & 4 and self.packed[12:14] == b"sl":
                length = struct.unpack("<I", self.packed[16:20])[0]
                self.after = self.file.tell() - len(self.packed) + length if 0 < length < 0xFFFFFFFF else None
            self.inflater = zlib.decompressobj(31)
            data, self.packed = self.packed, b""
        elif self.inflater.unconsumed_tail:
            data = self.inflater.unconsumed_tail
        elif not (data := self.file.read(_BLOCK)):
            raise ValueError("an archive ends within a record")
        self.held += self.inflater.decompress(data, 4 * _BLOCK)
        return True

    def skip(self, n: int) -> None:
        if self.after is not None:  # the rest of this record is the rest of its member
            self.file.seek(self.after)
            self.packed, self.held, self.inflater, self.after = b"", b"", None, None
            return
        while n > 0 and (got := len(self.read(min(n, _BLOCK)))):
            n -= got


def _records(source, wanted, with_payload: bool) -> Iterator[tuple]:
    """Rows of one archive; ``wanted`` sees the header fields before any payload is read."""
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = parse(head)
        length = int(fields.get("content-length", 0))
        row = {k: fields.get(name.lower()) for k, name in HEADERS.items()}
        row |= {"content_length": length, "payload_length": int(row["payload_length"]) if row["payload_length"] else None}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if wanted(row):
            if with_payload:
                row["payload"] = source.read(length)
                if len(row["payload"]) < length:
                    raise ValueError("an archive ends within a payload")
            else:
                row["payload"] = None
                source.skip(length)
            yield row
        else:
            source.skip(length)


# -- data source ------------------------------------------------------------------------------
_FIELDS = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.strip().split(" ") for x in SCHEMA.split(","))])
#: Bytes of the records that the reader hands on at once.
_BATCH = 4 << 20
_TESTED = {"record_type", "record_id", "target_uri", "payload_digest", "refers_to", "content_length", "page_id"}


@dataclass
class _File(InputPartition):
    path: str


class WarcSource(DataSource):
    """Registered under the name ``warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are only ever added; write to a new folder")
        return _Writer(self.options["path"], self.options.get("compression", "gzip"))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in kinds and name in _TESTED:
                self.tests.append((name, kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            have = row[name]
            if have is None:
                return False
            ok = {
                "=": lambda: have == value, "in": lambda: have in value, ">": lambda: have > value,
                ">=": lambda: have >= value, "<": lambda: have < value, "<=": lambda: have <= value,
            }[kind]()
            if not ok:
                return False
        return True

    def partitions(self):
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_File(root)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File]
        if lists := [p for p in files if p.rsplit("/", 1)[-1].startswith(LIST_NAME)]:
            names = set()
            for p in lists:
                with system.open_input_stream(p) as f:
                    names |= set(json.loads(f.read()))
            files = [f"{root.rstrip('/')}/{n}" for n in names]
        return [_File(p) for p in sorted(files) if p.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _File | None):
        if partition is None:  # there are no files
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file:
            source = _Gzip(file) if partition.path.endswith(".gz") else _Plain(file)
            held, size = [], 0
            for row in _records(source, self._wanted, self.payload):
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size > _BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    records: int


class _Writer(DataSourceArrowWriter):
    """Takes rows of ``SCHEMA``; content_length is that of the payload."""

    def __init__(self, path: str, compression: str):
        if compression not in ("gzip", "none"):
            raise ValueError(f"unknown compression {compression!r}")
        self.path, self.gzip = path, compression == "gzip"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, root = opened(self.path)
        name, n, out = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}", 0, None
        for row in (row for batch in batches for row in batch.to_pylist()):
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            fields = {k: None if row[k] is None else str(row[k]) for k in HEADERS}
            if fields["payload_digest"]:
                fields["payload_digest"] = "sha1:" + fields["payload_digest"]
            raw = record(fields, bytes(row["payload"] or b""))
            out.write(member(raw) if self.gzip else raw)
            n += 1
        if out is None:
            return _Written(None, 0)
        out.close()
        return _Written(name, n)

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        names = [m.file for m in messages if m is not None and m.file]
        with system.open_output_stream(f"{root}/{LIST_NAME}-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/{m.file}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let Spark hand filters to Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# -- archives of pages ------------------------------------------------------------------------
def write_pages(pages: DataFrame, path: str, *, id_column: str = "page_id", html_column: str = "html", url_column: str = "url", least_bytes: int = 0, compression: str = "gzip") -> None:
    """A record per page: of equal payloads of ``least_bytes`` or more the least page id is a response, others revisit it.

    A null html is an empty payload. Repeated rows that hold the least id are all responses; a
    null id revisits, if any other page has its payload. Equal payloads are known by their
    SHA-1; one row per digest meets the ids, and payloads move once, dealt by page.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.encode(pages[html_column].cast("string"), "utf-8"), F.lit(b""))
    rows = pages.select(pages[id_column].alias("id"), pages[url_column].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload"))
    keyed = rows.select("id", "sha").filter(F.col("size") >= least_bytes)
    first = keyed.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    again = keyed.join(first, "sha").filter("not (id <=> first)").distinct().select(F.col("id").alias("again"), F.col("sha").alias("again_sha"), "first")
    marked = rows.join(again, F.expr("id <=> again and sha = again_sha"), "left")
    marked = marked.select("id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "sha", "size", "first")

    def fields(batches):
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("id", "url", "payload", "sha", "size", "first")}
            n = batch.num_rows
            name = lambda page, sha: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha.hex()}')}>"
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name(i, s) for i, s in zip(get["id"], get["sha"], strict=True)]),
                    pa.array(["revisit" if f is not None else "response" for f in get["first"]]),
                    pa.array(get["url"], pa.string()),
                    pa.array([now] * n),
                    pa.array(["text/html"] * n),
                    pa.array([len(p or b"") for p in get["payload"]], pa.int64()),
                    pa.array([base64.b32encode(s).decode() for s in get["sha"]]),
                    pa.array([None if f is None else name(f, s) for f, s in zip(get["first"], get["sha"], strict=True)], pa.string()),
                    pa.array([None if i is None else str(i) for i in get["id"]], pa.string()),
                    pa.array(get["size"], pa.int64()),
                    pa.array(get["payload"], pa.binary()),
                ],
                names=_FIELDS,
            )

    marked.mapInArrow(fields, SCHEMA).write.format("warc").mode("append").option("compression", compression).save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    A response is measured and digested again from its payload; a revisit has the digest and
    length of its header. ``refers_to`` is the page id of the record that a revisit names.
    """
    register(spark)

    def measure(batches):
        for batch in batches:
            payloads, told = batch.column("payload").to_pylist(), batch.column("payload_digest").to_pylist()
            found = [digest32(p) for p in payloads]
            if found != told:
                raise ValueError("a payload does not fit its digest")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("record_id"), pa.array([len(p) for p in payloads], pa.int64()), pa.array(found)],
                names=["page_id", "record_id", "payload_bytes", "payload_digest"],
            )

    def of_type(kind: str, payload: bool) -> DataFrame:  # a relation of its own for every scan: Spark keeps one set of pushed filters for each
        found = spark.read.format("warc").option("payload", str(payload).lower()).load(path)
        return found.filter(F.col("record_type") == kind)

    full = of_type("response", True).select("page_id", "record_id", "payload", "payload_digest")
    responses = full.mapInArrow(measure, "page_id string, record_id string, payload_bytes long, payload_digest string")
    revisits = of_type("revisit", False).select("page_id", "refers_to", F.col("payload_length").alias("payload_bytes"), "payload_digest")
    named = of_type("response", False).select("record_id", F.col("page_id").alias("of")).distinct()
    again = revisits.join(named, revisits["refers_to"] == named["record_id"], "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"))
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    return own.unionByName(again)
