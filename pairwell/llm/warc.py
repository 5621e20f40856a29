"""WARC archives of pages: records compressed one by one with a Zstandard dictionary of their own archive.

An archive is a leading skippable frame that holds a dictionary trained on records of that archive, then one frame
per record, so a reader can start at any record. Of pages with equal payloads the one with the largest id is stored
in full (``response``), the others point to it (``revisit``).

Each task writes its rows into archives of about ``ARCHIVE_BYTES``; a name is unique for each attempt, and only
archives in the written list count, so a repeated or lost task leaves nothing that is read. Files go to the shared
folder of the session through the file systems of pyarrow; they are read back with Spark's own file reader.

Defined cases: NULL html is an empty payload; NULL or odd url characters are percent-encoded; rows with the same
payload and the same largest id (repeated rows) are all responses; of payloads whose ids are all NULL every row is
a response; NULL id stays NULL; too few records for training give an archive without dictionary; an empty table
gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.llm.common import join_facts
from pairwell.session import scratch_path

ARCHIVE_BYTES = 16_000_000
SAMPLE_BYTES = 1_500_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, response``: the id of the page that stores the payload."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    # Only payloads that occur more than once need their largest id.
    facts = rows.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    joined = join_facts(rows, facts, "digest", "page_id")
    return joined.select("page_id", "url", "html", F.coalesce("response", "page_id").alias("response"))


def name_of(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One WARC record with its headers."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    whole = page == response
    body = payload if whole else b""
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'response' if whole else 'revisit'}",
        f"WARC-Record-ID: {name_of(page)}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if not whole:
        heads += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name_of(response)}",
        ]
    heads += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame for each record."""
    sample, size = [], 0
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    for r in records[::step]:
        if size + len(r) > SAMPLE_BYTES and sample:
            break
        sample.append(r[:SAMPLE_BYTES])
        size += len(r)
    try:
        # Fixed parameters of the segment cover: no search over them.
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8, level=LEVEL)
        head = struct.pack("<II", SKIPPABLE, len(trained.as_bytes())) + trained.as_bytes()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    except zstandard.ZstdError:
        head, press = b"", zstandard.ZstdCompressor(level=LEVEL)
    return b"".join([head, *map(press.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    at, known = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        known = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
        at = 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(view):
        frame = reader.decompressobj()
        out = [frame.decompress(view[at : at + 65536])]
        at += 65536
        while not frame.eof:
            out.append(frame.decompress(view[at : at + 65536]))
            at += 65536
        at = min(at, len(view)) - len(frame.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page, payload bytes, digest, type and the page referred to; a response is measured by its own payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = page_of(fields["WARC-Record-ID"])
    if fields["WARC-Type"] == "response":
        payload = rest[: int(fields["Content-Length"])]
        return page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response", None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return page, int(fields["WARC-Payload-Length"]), digest, "revisit", page_of(fields["WARC-Refers-To"])


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, response`` rows as archives below ``folder``; the list of archives written."""
    root = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    root = root.replace("file:///", "file:/").replace("file:/", "file:///")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pyarrow.fs.FileSystem.from_uri(root)
        files.create_dir(f"{path}/archives", recursive=True)

        def put(pending: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{path}/archives/{name}", compression=None) as out:
                out.write(pack(pending))
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(pending)], pa.int64())})

        pending: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html, response in zip(*(batch.column(i) for i in range(4)), strict=True):
                pending.append(record(page.as_py(), url.as_py(), html.as_py(), response.as_py()))
                size += len(pending[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(pending)
                    pending, size = [], 0
        if pending:
            yield put(pending)

    written = records.mapInArrow(write, "name string, records long")
    written.write.parquet(f"{folder}/list")
    return records.sparkSession.read.parquet(f"{folder}/list")


def read_archives(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column(0):
                rows = [parse(r) for r in unpack(content.as_py())]
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    if listed.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{folder}/archives")
    found = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(listed, "name", "left_semi")
    return found.select("content").mapInArrow(read, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read_archives(spark, folder, write_archives(plan_records(pages), folder))
