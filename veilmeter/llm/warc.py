"""WARC archives as a PySpark data source, `warc`.

Writing: a task writes one file of WARC/1.1 records under a name of its own and notes where every few megabytes a record
begins; a commit writes these notes as a manifest, so files of failed or repeated attempts are never read. Each further write adds
a manifest; overwriting removes the earlier ones with their files. Reading: the
manifests' pieces become partitions. Headers are parsed first. Filters on record_type and on the other header columns are
pushed to the reader, which then does not inflate or read the payload of a record; so it does when no payload is asked for.

A record is a gzip member of its own, as is usual for WARC; its header's `sl` field holds the member's length, so a reader can
inflate just the record's head and go on to the next member. Without a manifest, all files *.warc and *.warc.gz of the folder
are read, a file a partition, whoever wrote them.

Files are opened through pyarrow.fs, so local, HDFS and object stores work alike.

Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload. A null payload counts as empty; a null
page_id or url is a record without that header; a revisit has headers only. Extra columns of the input are not written. Of equal
payloads the largest page_id is the response, null the smallest; rows that repeat that page_id are responses each, other repeated
rows are revisits each; an empty table is an archive without records; a very long payload is one record. A CR or LF in a url is
written as %0D or %0A and read back so, and blanks around a url are lost. A foreign record without a length has none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThanOrEqual,
    In,
    InputPartition,
    WriterCommitMessage,
)

from veilmeter.llm.common import shared_path, written

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HEADERS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
PIECE = 16 << 20
MANIFEST = "_manifest-"
MIN_REVISIT = 1000
FIRST = 2048  # packed bytes that are read of each member for its headers
KEPT = 200_000  # rows of repeated digests, some 15 MB, up to which they are broadcast
HEAD = 24  # bytes before a member's packed data


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(row) -> bytes:
    """One record; its payload, if any, follows an HTTP response head."""
    payload = b"" if row.payload is None else bytes(row.payload)
    revisit = row.record_type == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row.payload_bytes
    block = http if revisit else http + payload
    head = {
        "WARC-Type": row.record_type,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row.page_id}:{row.payload_digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if row.url is None else row.url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{row.payload_digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Page-ID": row.page_id,
        "WARC-Refers-To-Page-ID": row.refers_to,
        "WARC-Payload-Length": row.payload_bytes,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member whose extra field `sl` holds the lengths, packed and plain."""
    import struct
    import zlib

    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = pack.compress(data) + pack.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, HEAD + len(packed) + 8, len(data))
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


def members(stream, end: int) -> Iterator[tuple[bytes, Callable[[], bytes]]]:
    """Of each member up to `end`: the first bytes, inflated, and a function that reads and inflates all. What isn't asked for is neither read nor inflated."""
    import struct
    import zlib

    at = stream.tell()
    while at < end:
        size = struct.unpack("<2sHII", stream.read(HEAD)[12:])[2]
        begin = stream.read(min(FIRST, size - HEAD))

        def whole(at=at, size=size, begin=begin) -> bytes:
            stream.seek(at + HEAD + len(begin))
            return zlib.decompress(begin + stream.read(size - HEAD - len(begin)), -15)

        yield zlib.decompressobj(-15).decompress(begin, 4096), whole
        at += size
        stream.seek(at)


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


class Written(WriterCommitMessage):
    def __init__(self, file: str, starts: list[int], size: int):
        self.file, self.starts, self.size = file, starts, size


def manifests(system, root: str) -> list[str]:
    """One of each commit."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.path.rpartition("/")[2].startswith(MANIFEST))


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, size, starts = f"{uuid.uuid4().hex}.warc.gz", 0, []
        with system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as out:
            for row in rows:
                if not starts or size - starts[-1] >= PIECE:
                    starts.append(size)
                size += out.write(member(record(row)))
        return Written(name, starts, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        before = manifests(system, root) if self.overwrite else []
        files = [{"file": m.file, "starts": m.starts, "size": m.size} for m in messages if m]
        with system.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        for manifest in before:
            with system.open_input_stream(manifest) as f:
                old = json.loads(f.read())
            system.delete_file(manifest)
            for x in old:
                system.delete_file(f"{root}/{x['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for m in filter(None, messages):
            system.delete_file(f"{root}/{m.file}")


def parse_head(stream) -> dict | None:
    """The next record's headers as columns and its block's length; None at the end."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError("not at the start of a WARC record")
    head = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().partition(":")
        head[name.lower()] = value.strip()
    number = lambda k: int(head[k]) if k in head else None
    return {
        "page_id": number("warc-page-id"), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"),
        "payload_bytes": number("warc-payload-length"), "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2],
        "refers_to": number("warc-refers-to-page-id"), "length": number("content-length"),
    }


def payload_in(block: bytes) -> bytes:
    """What follows an HTTP head; a block without one is a payload as it is."""
    return block[block.index(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.tests = path, names, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(("in" if isinstance(f, In) else "ge" if isinstance(f, GreaterThanOrEqual) else "eq", f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        from pyarrow import fs

        system, root = _open(self.path)
        own = manifests(system, root)
        if not own:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
            return [Piece(x.path.removeprefix(f"{root}/"), 0, -1) for x in found if x.path.endswith((".warc", ".warc.gz"))] or [Piece("", 0, 0)]
        files = []
        for manifest in own:
            with system.open_input_stream(manifest) as f:
                files += json.loads(f.read())
        return [Piece(x["file"], a, b) for x in files for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]])] or [Piece("", 0, 0)]

    def wanted(self, head: dict) -> bool:
        for kind, name, value in self.tests:
            x = head[name]
            if x is None or not (x in value if kind == "in" else x >= value if kind == "ge" else x == value):
                return False
        return True

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.file:
            return
        import gzip
        import io

        system, root = _open(self.path)
        stream = io.BufferedReader(system.open_input_file(f"{root}/{piece.file}"), 1 << 20)
        if piece.end < 0:
            yield from self.read_all(gzip.GzipFile(fileobj=stream) if piece.file.endswith(".gz") else stream)
            return
        stream.seek(piece.start)
        for first, whole in members(stream, piece.end):
            if b"\r\n\r\n" not in first:
                first = whole()
            head = parse_head(io.BytesIO(first))
            if self.wanted(head):
                if self.payload_of(head):
                    block = whole()[: -4]
                    head["payload"] = payload_in(block[block.index(b"\r\n\r\n") + 4 :])
                yield tuple(head.get(n) for n in self.names)

    def payload_of(self, head: dict) -> bool:
        return "payload" in self.names and head["record_type"] != "revisit"

    def read_all(self, stream) -> Iterator[tuple]:
        """The records of a file of any writer, from one end to the other."""
        while head := parse_head(stream):
            head["length"] = head["length"] or 0
            skip = head["length"] + 4
            if self.wanted(head):
                if self.payload_of(head):
                    head["payload"], skip = payload_in(stream.read(head["length"])), 4
                yield tuple(head.get(n) for n in self.names)
            stream.seek(skip, 1)


class WarcSource(DataSource):
    """Options: path, a URI. The schema may name fewer columns; without payload, payloads are skipped."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame) -> DataFrame:
    """The records of pages (page_id, url, html). Of those with equal payloads of at least MIN_REVISIT bytes, the one with
    the largest page_id is the response and the others revisit it; rows that repeat that page_id are responses too."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = F.col("payload_bytes") >= MIN_REVISIT
    # Only digests that occur more than once, and no payloads, go through the aggregation.
    kept = (
        pages.select("page_id", payload.alias("payload")).filter(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy(F.sha1("payload").alias("payload_digest")).agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    kept = written(kept, "repeated")
    # Payloads stay where they lie while the repeated digests are few; else rows are dealt out by digest, where Spark splits a crowded one.
    kept = F.broadcast(kept) if kept.count() <= KEPT else kept
    again = large & (F.col("kept") != F.coalesce("page_id", F.lit(-(2**63))))
    return rows.join(kept, "payload_digest", "left").select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_bytes", "payload_digest",
        F.when(again, F.col("kept")).alias("refers_to"), F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    records(pages).write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    fields = dict(x.split(" ") for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {fields[c]}" for c in columns or fields)).option("path", path).load()


def op10(pages: DataFrame) -> DataFrame:
    """Archives written and read back. What a record says of its payload is checked against the payload itself."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path)
    back = read(spark, path)
    whole = F.col("record_type") == "response"
    checked = {"payload_bytes": F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")), "payload_digest": F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest"))}
    return back.withColumns(checked).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
