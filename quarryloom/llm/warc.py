"""WARC archives as a Spark data source, read and written.

`spark.read.format("warc")` plans one partition per archive file. It parses the WARC headers of a record first; records
that the pushed predicates (on record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes: equality,
IN, prefix, comparison, null tests) reject are skipped unread: plain files are hopped over by Content-Length, gzip members
by their `sl` extra field, which this writer sets; foreign members without it are inflated and dropped. The option
payload=false skips payloads of all records. `df.write.format("warc")` writes one gzip member per record and lists the
files of the successful tasks in a manifest of its own, so files of lost attempts are never read. Appending adds a
manifest; overwriting drops those that were there, with their files, once the new one is written. A folder without
manifests, of archives from elsewhere, is read whole; where there are manifests, only the files that they list.

Records need record_id, target_uri, payload (binary), record_type (response or revisit), refers_to, payload_digest
(hex SHA-1 of the whole payload) and payload_bytes. A null payload counts as empty. A revisit stores the HTTP header with the
length of the full payload but not the payload.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage

from quarryloom.llm.storage import maybe_among, saved, shared_folder, temporary
from quarryloom.sources.tables import table

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, REVISIT_FROM_BYTES = "_files-", 1000


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def record(row: dict) -> tuple[bytes, bytes]:
    """WARC header and block (with its end) of a record."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    size = row["payload_bytes"] if revisit else len(payload)
    block = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + (b"" if revisit else payload)
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = VERSION + _header([
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Identified-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ])
    return head, block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field `sl` has its compressed and plain length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse(head: bytes) -> dict:
    """The columns of a record but its payload, from its WARC header."""
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    strip = lambda v: v and v.removeprefix("<").removesuffix(">")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    number = fields.get("warc-identified-payload-length")
    return {
        "record_id": strip(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": strip(fields.get("warc-refers-to")),
        "payload_digest": base64.b32decode(digest).hex() if len(digest) == 32 else (digest.lower() or None), "payload_bytes": int(number) if number else None, "_length": int(fields.get("content-length", 0)),
    }


def body(block: bytes) -> bytes:
    """The payload of an HTTP block."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class _Member:
    """The plain bytes of the gzip member that a stream stands at, inflated as far as they are asked for."""

    def __init__(self, stream):
        self.stream, self.inflate, self.held = stream, zlib.decompressobj(31), b""

    def more(self, size: int) -> bool:
        """Inflates up to `size` bytes; whether there were any."""
        while not self.inflate.eof and (chunk := self.inflate.unconsumed_tail or self.stream.read(4096 if size <= 4096 else 1 << 18)):
            if data := self.inflate.decompress(chunk, size):
                self.held += data
                return True
        return False

    def head(self) -> bytes | None:
        """The next record's header; line ends between records are passed over. None at the member's end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            head, found, rest = self.held.partition(b"\r\n\r\n")
            if found:
                self.held = rest
                return head
            if not self.more(4096):
                return None

    def take(self, size: int) -> bytes:
        parts, have = [self.held], len(self.held)
        self.held = b""
        while have < size and self.more(1 << 18):
            parts.append(self.held)
            have += len(self.held)
            self.held = b""
        data = b"".join(parts)
        self.held = data[size:]
        return data[:size]

    def skip(self, size: int) -> None:
        while size > len(self.held):
            size -= len(self.held)
            self.held = b""
            if not self.more(1 << 18):
                return
        self.held = self.held[size:]

    def close(self) -> None:
        """Puts the stream at the first byte after the member."""
        while not self.inflate.eof and self.more(1 << 18):
            self.held = b""
        self.stream.seek(self.stream.tell() - len(self.inflate.unused_data))


def _gzip_records(stream, wanted):
    """Records of concatenated gzip members of one or more each. A member that carries its length and holds one record is
    jumped over as soon as the header shows that its payload is not wanted."""
    while True:
        start = stream.tell()
        first = stream.read(12)
        if len(first) < 12:
            return
        size = plain = None
        if first[3] & 4:
            extra = stream.read(struct.unpack("<H", first[10:12])[0])
            if len(extra) >= 12 and extra[:2] == b"sl":
                size, plain = struct.unpack("<II", extra[4:12])
        stream.seek(start)
        member = _Member(stream)
        while (head := member.head()) is not None:
            row = parse(head)
            keep = wanted(row)
            if keep == 2:
                row["payload"] = body(member.take(row["_length"]))
            if keep:
                yield row
            if size is not None and (len(head) + row["_length"] + 8) & 0xFFFFFFFF == plain:
                break
            if keep != 2:
                member.skip(row["_length"])
        if size is None:
            member.close()
        else:
            stream.seek(start + size)


def _plain_records(stream, wanted):
    while True:
        head = b""
        start = stream.tell()
        while b"\r\n\r\n" not in head and (chunk := stream.read(4096)):
            head += chunk
        if b"\r\n\r\n" not in head:
            return
        head = head.partition(b"\r\n\r\n")[0]
        row = parse(head)
        at = start + len(head) + 4
        if keep := wanted(row):
            if keep == 2:
                stream.seek(at)
                row["payload"] = body(stream.read(row["_length"]))
            yield row
        stream.seek(at + row["_length"] + 4)


_TESTS = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}
_HEADER_COLUMNS = set(_ARROW.names) - {"payload"}


def _test(f):
    """A test of header columns for a pushed predicate, or None where there is none."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (lambda row: row[f.child.attribute[0]] is not None and not inner(row)) if not isinstance(f.child, (EqualNullSafe, IsNull, IsNotNull, Not)) else None
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in _HEADER_COLUMNS:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNull):
        return lambda row: row[name] is None
    if isinstance(f, IsNotNull):
        return lambda row: row[name] is not None
    if type(f) not in _TESTS:
        return None
    test = _TESTS[type(f)]
    return lambda row: row[name] is not None and test(row[name], f.value)


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listing(store, root: str) -> tuple[set[str], dict[str, set[str]] | None]:
    """The archives in a folder, and those that each of its manifests lists; None if it has no manifests."""
    names = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    listed = {}
    for path in names:
        if path.rpartition("/")[2].startswith(MANIFEST):
            with store.open_input_stream(path) as lines:
                listed[path] = {f"{root}/{x}" for x in lines.read().decode().split("\n") if x}
    return {x for x in names if x.endswith((".warc", ".warc.gz"))}, listed or None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        store, root = _store(self.path)
        found, listed = _listing(store, root)
        files = found if listed is None else found & set().union(*listed.values())
        return [InputPartition(x) for x in sorted(files)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        tests = [_test(f) for f in self.filters]
        wanted = lambda row: (1 + self.payload) * all(t(row) for t in tests)
        store, _ = _store(self.path)
        held, size = [], 0
        with store.open_input_file(partition.value) as stream:
            for row in (_gzip_records if partition.value.endswith(".gz") else _plain_records)(stream, wanted):
                if row["record_type"] == "revisit":
                    row["payload"] = None
                held.append({k: row.get(k) for k in _ARROW.names})
                size += 500 + len(row.get("payload") or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


class Written(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 1)), overwrite

    def _store(self):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        return store, root

    def write(self, iterator):
        store, root = self._store()
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(b"".join(record(row)), self.level))
        return Written(name)

    def commit(self, messages):
        store, root = self._store()
        found, before = _listing(store, root)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}") as out:
            out.write("\n".join(m.name for m in messages if m is not None).encode())
        if self.overwrite:
            new = {f"{root}/{m.name}" for m in messages if m is not None}
            for path in [*(before or {}), *sorted((found if before is None else set().union(*before.values())) & found - new)]:
                store.delete_file(path)

    def abort(self, messages):
        store, root = self._store()
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; predicates are pushed only if the session says so, which is set here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, *, page_id: str, payload: Column, uri: Column, revisit_from: int = REVISIT_FROM_BYTES) -> DataFrame:
    """Records of pages: of equal payloads of `revisit_from` bytes or more the page with the largest id is the response
    and the others revisit it. Rows that repeat the largest id are all responses."""
    base = pages.select(F.col(page_id).alias("id"), uri.alias("target_uri"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = base.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("id").alias("largest"))
    large = saved(large.where("n > 1"), "equal-payloads").select("payload_digest", "largest")
    maybe, rest = maybe_among(base, "payload_digest", large.select("payload_digest"))
    # The payload stays with responses alone, so those that go to the join for nothing are few.
    joined = maybe.join(large, "payload_digest", "left").select(*base.columns, "largest")
    rows = joined.unionByName(rest.withColumn("largest", F.lit(None).cast(base.schema["id"].dataType)))
    revisit = F.coalesce(F.col("id") != F.col("largest"), F.col("largest").isNotNull())
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return rows.select(
        F.coalesce(name("id"), F.lit("urn:page:")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, name("largest")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page into archives and reads them back: payloads of responses, headers alone of revisits."""
    register(spark)
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    with temporary(spark):
        records = revisits(pages, page_id="page_id", payload=F.col("html").cast("binary"), uri=F.col("url"))
        records.write.format("warc").mode("append").save(path)
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(path)
    full = read("true").where("record_type = 'response'").select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    short = read("false").where("record_type = 'revisit'").select("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return full.unionByName(short).select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.largest IS NULL OR g.largest = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.largest <> p.page_id THEN g.largest END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.n >= 1000
"""
