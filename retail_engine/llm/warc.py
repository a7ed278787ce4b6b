"""WARC archives of pages, and the normaliser of monolithic gzip files.

Tasks write archives as one gzip stream each, in which no record can be reached without
inflating all before it. The normaliser inflates such a stream once, piece by piece, writes
every record again as a gzip member of its own, and beside the archive an index of offsets,
one JSON line a record. Reading goes by that index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_engine.llm.common import shared_folder, small_batches, stored

_PIECE = 1 << 20
_LEVEL = 3
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6f2b5d0e-38e4-4a35-9c0b-6a4b51d0a7c1")

INDEX = (
    "file string, offset long, length long, record_id string, record_type string, uri string, "
    "page_id long, payload_digest string, refers_to long"
)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; Hadoop writes local ones with one slash."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class _Output:
    """A file that gets its name when it is complete, so that a lost task leaves none half done."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.fs.open_output_stream(self.part, compression=None)
        self.write = self.stream.write

    def close(self) -> None:
        self.stream.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One WARC record; headers that are None are left out, line ends in values are escaped."""
    lines = ["WARC/1.1"]
    for name, value in fields.items():
        if value is not None:
            lines.append(f"{name}: {value.replace('\r', '%0D').replace('\n', '%0A')}")
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def _page_record(row: dict) -> bytes:
    payload = row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    name = lambda at: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(at))}>"
    number = lambda x: None if x is None else str(x)
    revisit = row["first_at"] is not None and row["first_at"] != row["at"]
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name(row["at"]),
        "WARC-Date": _DATE,
        "WARC-Target-URI": row["url"],
        "WARC-Payload-Digest": "sha1:" + digest_of(payload),
        "X-Page-Id": number(row["page_id"]),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields |= {
            "WARC-Profile": _PROFILE,
            "WARC-Refers-To": name(row["first_at"]),
            "X-Refers-To-Page": number(row["first_page"]),
        }
    return record(fields, http if revisit else http + payload)


def _marked(pages: DataFrame, least_bytes: int) -> DataFrame:
    """at, page_id, url, payload, and the first row of equal payloads where there are several."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("at"),
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    # Null ids come last; of equal ids the first row in the input is the one referred to.
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "at")
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
    groups = groups.agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
    groups = stored(
        groups.select(
            "digest",
            F.col("first.at").alias("first_at"),
            F.col("first.page_id").alias("first_page"),
        ),
        "repeated-payloads",
    )
    return rows.join(groups, "digest", "left").drop("digest")


def write_monolithic(
    pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 256 << 20
) -> DataFrame:
    """Write `pages` (page_id, url, html) to gzip streams below `path`; returns their names.

    Of records with equal payloads of `least_bytes` or more, the one with the smallest page_id
    is a response and the others revisit it. A null html is an empty payload, a null url or
    page_id leaves out its header. A task begins a new file after `file_bytes` of records.
    `pages` is scanned twice, so it must be read from files.
    """
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, out, room = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"{path}/pages-{part:06d}-{len(files):04d}.warc.gz")
                    out, room = _Output(files[-1]), file_bytes
                    squeeze = zlib.compressobj(_LEVEL, wbits=31)
                body = _page_record(row)
                out.write(squeeze.compress(body))
                room -= len(body)
                if room <= 0:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string())})

    return stored(_marked(pages, least_bytes).mapInArrow(write, "file string"), "archives")


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece."""
    inflate = zlib.decompressobj(wbits=31)
    while data := stream.read(_PIECE):
        while data:
            while data and not inflate.eof:
                yield inflate.decompress(data, _PIECE)
                data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data or data
                inflate = zlib.decompressobj(wbits=31)
                if not data.strip(b"\0"):
                    break
    yield inflate.flush()


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, block and all bytes of each record; one record is held at a time."""
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        headers = _headers(bytes(held[:end]))
        size = end + 4 + int(headers["content-length"])
        if not fill(size + 4):
            raise ValueError("the archive ends within a record")
        yield headers, bytes(held[end + 4 : size]), bytes(held[: size + 4])
        del held[: size + 4]


def _entry(headers: dict[str, str]) -> dict:
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "record_id": headers.get("warc-record-id"),
        "record_type": headers.get("warc-type"),
        "uri": headers.get("warc-target-uri"),
        "page_id": number("x-page-id"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": number("x-refers-to-page"),
    }


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrite the archives (column file) below `path`; returns the index, read from its files.

    Every record becomes a gzip member; <archive>.index.json beside an archive has a line for
    each: file, offset and length of its member, and its main headers.
    """
    spark = archives.sparkSession
    # A file is a task's work whatever the length of the list is.
    files = archives.repartition(max(1, archives.count()), "file")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("file").to_pylist():
                name = f"{path}/{source.rsplit('/', 1)[1]}"
                out, index, offset = _Output(name), _Output(f"{name}.index.json"), 0
                fs, place = _open(source)
                with fs.open_input_stream(place, compression=None) as stream:
                    for headers, _, whole in records(inflated(stream)):
                        squeeze = zlib.compressobj(_LEVEL, wbits=31)
                        member = squeeze.compress(whole) + squeeze.flush()
                        out.write(member)
                        line = {"file": name, "offset": offset, "length": len(member)}
                        index.write((json.dumps(line | _entry(headers)) + "\n").encode())
                        offset += len(member)
                out.close()
                index.close()
            yield batch.select(["file"])

    done = stored(files.mapInArrow(rewrite, "file string"), "normalised")
    if not done.take(1):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json(f"{path}/*.index.json")


def read_back(index: DataFrame) -> DataFrame:
    """Each indexed record from its member: page_id, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits).

    A response's digest is taken of the payload and must equal its header's.
    """
    small_batches(index.sparkSession)
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["file"] != name:
                    name = entry["file"]
                    fs, place = _open(name)
                    stream = fs.open_input_file(place)
                stream.seek(entry["offset"])
                whole = zlib.decompress(stream.read(entry["length"]), wbits=31)
                headers, block, _ = next(records(iter([whole])))
                row = _entry(headers)
                http, _, payload = block.partition(b"\r\n\r\n")
                row["payload_bytes"] = int(_headers(http)["content-length"])
                if row["record_type"] == "response":
                    row["payload"] = payload
                    if digest_of(payload) != row["payload_digest"]:
                        raise ValueError(f"damaged record {row['record_id']} in {name}")
                rows.append({f.name: row.get(f.name) for f in schema})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return index.mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary",
    )


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write, normalise and read back `pages`, below `path` or a new shared folder."""
    path = path or shared_folder(pages.sparkSession, "warc")
    files = write_monolithic(pages, f"{path}/monolithic")
    return read_back(normalise(files, f"{path}/members"))
