"""WARC archives of individually compressed records with an embedded dictionary.

An archive starts with a skippable Zstandard frame that holds a dictionary, built from
the first records of the archive itself; every record is a frame of its own, compressed
with it, so single records can be read at an offset. Each task streams its rows into
archives of bounded size: it buffers a bounded number of bytes of records, builds the
dictionary, and writes on. It returns one manifest row per archive; only archives named
by the manifest count, so files of lost or repeated attempts are ignored.

Equal payloads are archived once: payload digests are grouped with map-side combining,
and only digests that occur more than once are joined to the pages.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm import store
from citegrid.session import Scratch

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
MIN_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"
_CHUNK = 1 << 14


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record; pages without id are told apart by their payload."""
    name = f"page:{page_id}" if page_id is not None else f"payload:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record that refers to the page with the equal payload."""
    digest = sha1_base32(payload)
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = head + payload if refers_to is None else head
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", target),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                   ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(fields, payload, length of the full payload); checks lengths and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if fields["WARC-Type"] == "response":
        if len(payload) != size or f"sha1:{sha1_base32(payload)}" != fields["WARC-Payload-Digest"]:
            raise ValueError("payload does not match its digest")
    return fields, payload, size


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; too few of them serve as raw content."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to a stream; the first ``sample_bytes`` build the dictionary."""

    def __init__(self, stream, dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES,
                 level: int = LEVEL):
        self.stream, self.dictionary_bytes, self.sample_bytes, self.level = stream, dictionary_bytes, sample_bytes, level
        self.waiting: list[bytes] = []
        self.held, self.at, self.count = 0, 0, 0
        self.pack = None

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _start(self) -> None:
        dictionary = train(self.waiting, self.dictionary_bytes)
        dictionary.precompute_compress(level=self.level)
        content = dictionary.as_bytes()
        self._put(SKIPPABLE.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content)
        self.pack = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self._put(self.pack.compress(record))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.count += 1
        if self.pack is not None:
            self._put(self.pack.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= self.sample_bytes:
            self._start()

    def close(self) -> None:
        if self.pack is None:
            self._start()
        self.stream.close()


def read_records(source) -> Iterator[bytes]:
    """The records of an archive, frame by frame, with the dictionary of its first frame."""
    end = source.size()
    head = source.read_at(8, 0)
    if int.from_bytes(head[:4], "little") != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    size = int.from_bytes(head[4:], "little")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read_at(size, 8)))
    at = 8 + size
    while at < end:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            chunk = source.read_at(min(_CHUNK, end - at), at)
            if not chunk:
                raise ValueError("the archive is cut off")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
        yield b"".join(parts)


def _write(root: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def run(batches):
        writer, uri = None, ""

        def manifest():
            writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([writer.count], pa.int64()), pa.array([writer.at], pa.int64())],
                names=["uri", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in columns)
                if writer is None:
                    uri = f"{root}/{store.new_name('pages', '.warc.zst')}"
                    writer = ArchiveWriter(store.create(uri), dictionary_bytes, sample_bytes, level)
                writer.add(build_record(page_id, url, payload, refers_to))
                if writer.at >= archive_bytes:
                    yield manifest()
                    writer = None
        if writer is not None:
            yield manifest()
    return run


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES,
                   sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL,
                   scratch: Scratch | None = None) -> DataFrame:
    """Archive ``(page_id, url, html)``; returns the manifest ``(uri, records, bytes)``.

    Of pages whose equal payloads have at least ``min_bytes`` bytes the one with the
    largest id is a response, pages with smaller ids or none revisit it. Null html is an
    empty payload. Rows that repeat the largest id are all responses, and so are pages
    without id if none of the equal ones has an id.
    """
    store.short_batches(pages.sparkSession)
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn(
        "digest", F.sha1("payload"))
    shared = scratch.save(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"))
        .where((F.col("n") > 1) & F.col("last").isNotNull()).select("digest", "last"), "shared")
    revisits = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    root = store.folder(pages.sparkSession, "archives")
    return scratch.save(
        rows.join(shared, "digest", "left").select("page_id", "url", "payload", revisits.alias("refers_to"))
        .mapInArrow(_write(root, archive_bytes, sample_bytes, dictionary_bytes, level),
                    "uri string, records bigint, bytes bigint"), "manifest")


def _read(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            out: list[list] = [[], [], [], [], [], []]
            with store.open_file(uri) as source:
                for data in read_records(source):
                    fields, _, size = parse_record(data)
                    page_id, refers_to = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                    for c, v in zip(out, (None if page_id is None else int(page_id), size,
                                          fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"],
                                          None if refers_to is None else int(refers_to), fields["WARC-Target-URI"])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.string()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.string())],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that the manifest names."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("uri").repartition(n, "uri").mapInArrow(
        _read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
               "target_uri string")


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages, then read the archives back. An empty table gives no archive and no row."""
    return read_archives(write_archives(pages, **options))
