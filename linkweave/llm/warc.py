"""Web archives of Zstandard frames: written from rows, read back with every length and digest checked.

An archive is a file of frames. The first is a skippable frame that holds the dictionary (magic 0x184D2A5D, a length,
the dictionary as it is or itself compressed); then each record is one frame. Spark's text writer writes the files, one row
per frame, with an empty skippable frame in place of a line end, which readers pass over; so archives go
wherever Spark can write. A task starts a new archive, dictionary first, after `records_per_file` records or
`bytes_per_file` bytes.

Records follow WARC 1.1: a version line, headers, an empty line, a block of Content-Length bytes, two line ends. A response's
block is an HTTP response whose body is the payload. A page whose payload is that of an earlier record (by SHA-1 and
length) becomes a revisit record: the block keeps the HTTP headers, with the payload's length, and leaves out the body.

Reading checks the frame structure, that a frame holds exactly one record, the version, that required headers are there
and once, the block's length and digest, and the payload's length and digest. A damaged archive raises an error
that names the file and the position.

Defined cases: a null payload is written as an empty one; of rows with equal payloads, all with the smallest id are
responses, so a repeated row is written twice; rows with a null id are written as revisits of a row with an id if there is one,
else as responses; an empty table gives no archives and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.session import shared_folder

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
# an empty skippable frame, as text: what the writer puts behind each row
FRAME_END = struct.pack("<II", SKIPPABLE[0], 0).decode("ascii")
REQUIRED = ("WARC-Record-ID", "WARC-Type", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"


class ArchiveError(ValueError):
    """An archive that does not keep to the format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# ---- records


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, date: str) -> bytes:
    """One record; `first_id` names the record whose payload is the same, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + payload if first_id is None else http
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "") or "about:blank"
    headers = [
        ("WARC-Type", "response" if first_id is None else "revisit"),
        ("WARC-Record-ID", _ID.format("none" if page_id is None else page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if first_id is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _ID.format(first_id))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) after the first line, and where what follows them begins."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError("headers do not end")
    out: dict[str, str] = {}
    for line in data[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"header line without a name: {line!r}")
        if name.strip().lower() in out:
            raise ArchiveError(f"header twice: {name}")
        out[name.strip().lower()] = value.strip()
    return out, end + 4


def _number(value: str | None, what: str) -> int:
    if value is None or not value.isdigit():
        raise ArchiveError(f"{what} is not a length: {value}")
    return int(value)


def parse(data: bytes) -> dict:
    """The fields of one record; raises ArchiveError where something does not fit."""
    if not data.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n")):
        raise ArchiveError("no version line")
    headers, start = _headers(data)
    if missing := [h for h in REQUIRED if h.lower() not in headers]:
        raise ArchiveError(f"headers missing: {missing}")
    length = _number(headers["content-length"], "Content-Length")
    if len(data) != start + length + 4 or data[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(data) - start - 4} bytes, {length} announced")
    block = data[start : start + length]
    if headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ArchiveError("block digest differs")
    out = {"id": headers["warc-record-id"], "type": headers["warc-type"], "uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "payload": None}
    if out["type"] not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": length, "payload_digest": digest(block)}
    if not block.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP status line")
    http, body = _headers(block)
    out["payload_bytes"] = _number(http.get("content-length"), "the HTTP Content-Length")
    named = headers.get("warc-payload-digest")
    if out["type"] == "response":
        out["payload"] = block[body:]
        if len(out["payload"]) != out["payload_bytes"]:
            raise ArchiveError(f"the payload has {len(out['payload'])} bytes, {out['payload_bytes']} announced")
        if named not in (None, f"sha1:{digest(out['payload'])}"):
            raise ArchiveError("payload digest differs")
        named = f"sha1:{digest(out['payload'])}"
    elif named is None or not named.startswith("sha1:"):
        raise ArchiveError("revisit without a payload digest")
    return out | {"payload_digest": named.removeprefix("sha1:")}


# ---- frames


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def _frame_size(data: bytes, at: int) -> int:
    """Length of the frame at `at`: header, blocks, checksum."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + size + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        block = int.from_bytes(data[at + size : at + size + 3], "little")
        size += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    size += 4 * (flags >> 2 & 1)
    if at + size > len(data):
        raise ArchiveError("a frame is cut off")
    return size


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, record) of each frame of an archive; loads the dictionary from the leading skippable frame."""
    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        if at + 8 > len(data):
            raise ArchiveError(f"at {at}: {len(data) - at} bytes behind the last frame")
        magic, length = struct.unpack_from("<II", data, at)
        try:
            if magic in SKIPPABLE:
                if at + 8 + length > len(data):
                    raise ArchiveError("a skippable frame is cut off")
                if magic == DICTIONARY_MAGIC:
                    if at:
                        raise ArchiveError("a dictionary that does not lead the archive")
                    raw = data[8 : 8 + length]
                    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
                at += 8 + length
                continue
            if magic != FRAME_MAGIC:
                raise ArchiveError("no frame")
            size = _frame_size(data, at)
            yield at, reader.decompressobj().decompress(data[at : at + size])
            at += size
        except (ArchiveError, zstandard.ZstdError) as e:
            raise ArchiveError(f"at {at}: {e}") from e


# ---- on Spark


def train_dictionary(pages: DataFrame, payload_col: str = "html", samples: int = 400, sample_bytes: int = 8192, size: int = 32_768) -> bytes:
    """A dictionary from the beginnings of about `samples` different payloads, chosen by hash. Any dictionary is right; a
    better one packs better. Where there is too little to train on, the samples themselves serve."""
    text = F.col(payload_col).cast("string")
    some = pages.filter(F.length(text) > 0).select(F.substring(text, 1, sample_bytes).alias("t"), F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("h"))
    share = samples / max(some.count(), 1)
    # equal payloads have equal hashes: they are merged before anything is gathered
    found = sorted(r["t"].encode("utf-8") for r in some.filter(F.col("h") < int(share * (1 << 30)) + 1).groupBy("h").agg(F.min("t").alias("t")).limit(2 * samples).collect())
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[:size]


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", records_per_file: int = 2048, bytes_per_file: int = 1 << 26, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row into archives in the folder `path`."""
    dictionary = train_dictionary(pages, payload_col)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_sha1", F.sha1("_payload")).withColumn("_size", F.octet_length("_payload"))
    firsts = rows.groupBy("_sha1", "_size").agg(F.min("_id").alias("_first")).filter("_first is not null")
    rows = rows.join(firsts, ["_sha1", "_size"], "left")
    revisit = F.when(F.col("_id").isNull() | (F.col("_id") > F.col("_first")), F.col("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
        left, room = 0, 0  # rows and bytes that the archive in work still takes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    if room <= 0:  # empty rows bring the writer to its next file
                        out += [b""] * left
                        left = 0
                    if not left:
                        out.append(dictionary_frame(dictionary))
                        left, room = records_per_file, bytes_per_file
                    out.append(writer.compress(record(r["_id"], r["_url"], r["_payload"].encode("utf-8"), r["_refers"], date)))
                    left, room = left - 1, room - len(out[-1])
                yield pa.record_batch([pa.array(out, pa.binary())], names=["frame"])

    made = rows.select("_id", "_url", "_payload", revisit.alias("_refers")).mapInArrow(run, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", FRAME_END).option("maxRecordsPerFile", records_per_file + 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target_uri, payload, payload_bytes, payload_digest, refers_to) of each record in a folder of
    archives; the payload is null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                held: list[dict] = []
                at, held_bytes = 0, 0
                try:
                    for at, data in frames(content.as_py()):
                        held.append(parse(data))
                        held_bytes += len(data)
                        if held_bytes > 1 << 22:
                            yield _rows(held)
                            held, held_bytes = [], 0
                except (ArchiveError, UnicodeDecodeError) as e:
                    raise ArchiveError(f"{name}, record at {at} or the one behind it: {e}") from e
                if held:
                    yield _rows(held)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, "record_id string, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def _rows(held: list[dict]) -> pa.RecordBatch:
    names = {"record_id": "id", "record_type": "type", "target_uri": "uri", "payload": "payload", "payload_bytes": "payload_bytes", "payload_digest": "payload_digest", "refers_to": "refers_to"}
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    return pa.record_batch([pa.array([r[k] for r in held], kinds.get(k, pa.string())) for k in names.values()], names=list(names))


def page_of(record_id: Column) -> Column:
    """The id in a record's name; null for a record without one."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)


def query(pages: DataFrame) -> DataFrame:
    """Archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path).select(
        page_of(F.col("record_id")).try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", page_of(F.col("refers_to")).try_cast("long")).alias("refers_to"),
    )
