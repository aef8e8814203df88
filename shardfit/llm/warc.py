"""Dictionary-compressed WARC archives.

Every row becomes a WARC/1.1 record of its own Zstandard frame, so a record can be read alone.
A dictionary trained on a bounded sample of the records goes into a skippable frame at the
head of every archive; a reader needs nothing but the archive. Records with equal payloads of
some size are written once, as a response, and else as revisits that name it.

Archives lie in a folder that all executors see. A task writes one archive under a name of
its own attempt and gives back its path; the paths of the attempts that counted are kept in a
table, so files of lost or repeated attempts are never read. Reading starts from that table.
"""

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardfit.functions.shared import Shared
from shardfit.functions.sizes import broadcast_if_small
from shardfit.functions.checkpoints import shared_folder
from shardfit.llm.common import keep

#: Magic numbers of the dictionary frame and of Zstandard frames.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
LEAST_BYTES = 1000         # smaller payloads are always written in full
DICTIONARY_BYTES = 112_640
SAMPLE = 400               # records that the dictionary is trained on
ARCHIVE_ROWS_BYTES = 256 << 20  # payload of one archive at most, but for one longer record
LEVEL = 3


def decisions(pages: DataFrame, key: str, payload: str, least: int = LEAST_BYTES) -> DataFrame:
    """The table with `payload_bytes, payload_digest, record_type, refers_to` of each row.

    Of equal payloads of at least `least` bytes the one with the largest key is the response;
    repeated rows with that key are responses all. A null key never outranks another and,
    alone or among nulls, is a response.
    """
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
                        raw.alias("payload"), F.octet_length(raw).cast("long").alias("payload_bytes"),
                        F.sha1(raw).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
    heads = keep(large.agg(F.max("key").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null"))
    joined = rows.join(broadcast_if_small(heads.select("payload_digest", "head"), heads.count(), 200_000), "payload_digest", "left")
    revisit = F.coalesce(F.col("head") != F.col("key"), F.col("head").isNotNull() & F.col("key").isNull())
    return joined.select(
        "key", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("head")).alias("refers_to"))


def record(key, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record; a revisit has no payload, but its digest and what it refers to."""
    body = payload if kind == "response" else b""
    name = lambda k: f"<urn:page:{'none' if k is None else k}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(key)}",
             "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {name(refers_to)}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def train(pages: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most about `sample` of the records, drawn by a hash; empty if too few."""
    rows = pages.select("key", "url", "payload", "payload_digest", "record_type", "refers_to")
    n = max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64("payload_digest", "key"), F.lit(1 << 30)) < F.lit(int(min(1, sample / n) * (1 << 30))))
    parts = [record(*r) for r in drawn.limit(2 * sample).toLocalIterator()]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _store(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str | None = None, level: int = LEVEL) -> DataFrame:
    """Write archives of the rows of `decisions` and return `path, records, bytes` of each."""
    spark = pages.sparkSession
    folder = (folder or shared_folder(spark)).rstrip("/") + f"/warc-{uuid.uuid4().hex}"
    sent = Shared(spark, (train(pages), folder, level))

    def run(batches: Iterator[pa.RecordBatch]):
        dictionary, folder, level = sent.value
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
        context, number, out = TaskContext.get(), 0, None
        done = {"path": [], "records": [], "bytes": []}

        def close():
            done["path"].append(name)
            done["records"].append(n)
            done["bytes"].append(out.tell())
            out.close()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{folder}/{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
                    out, n, held = store.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), 0, 0
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                raw = record(row["key"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"])
                out.write(press.compress(raw))
                n, held = n + 1, held + len(raw)
                if held >= ARCHIVE_ROWS_BYTES:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict(done, schema=pa.schema(
            [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return keep(pages.select("key", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(
        run, "path string, records long, bytes long"))


def frames(stream, dictionary: bytes | None = None, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Contents of the frames of an archive, one after the other, in bounded memory."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = stream.read(size)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpack, held = zstandard.ZstdDecompressor(dict_data=data), b""
    while held := held or stream.read(chunk):
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else stream.read(chunk)
            if not held and not one.eof:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """`key, url, record_type, payload, payload_bytes, payload_digest, refers_to` of all records.

    Payloads of revisits are null. A response whose payload does not have its digest is an error.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = _store(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for raw in frames(stream):
                        rows.append(_row(*parsed(raw)))
                        held += len(raw)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    n = max(1, archives.count())
    spread = archives.select("path").repartition(min(n, 100_000), "path")
    return spread.mapInArrow(run, "key long, url string, record_type string, payload binary, payload_bytes long, "
                                  "payload_digest string, refers_to long")


_SCHEMA = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
_NUMBER = re.compile(r"<urn:page:(-?\d+)>")


def _row(fields: dict[str, str], body: bytes) -> dict:
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(m[1]) if (m := _NUMBER.fullmatch(fields.get(name, ""))) else None
    return {"key": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
            "payload": body if kind == "response" else None, "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": digest, "refers_to": number("WARC-Refers-To")}


def archive(pages: DataFrame, key="page_id", payload="html") -> DataFrame:
    """Write archives of all rows and read them back.

    Null payloads count as empty; rows with equal or null keys are records of their own; an
    empty table gives no archive and no row. Columns other than key, url and payload are not
    read.
    """
    written = write(decisions(pages, key, payload))
    return read(pages.sparkSession, written).withColumnRenamed("key", key)
