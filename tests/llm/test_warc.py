import base64
import hashlib
import struct

import pytest
import zstandard

from linkweave.llm import warc


def page_rows():
    rows = [(i, f"http://x/{i}", f"<html><p>page {i % 40}</p>" + "text " * (i % 40), "u") for i in range(120)]
    rows += [(500, None, None, "u"), (501, "http://y/ ä\n", "", None), (3, "http://x/3", rows[3][2], "u"), (None, "http://z", rows[5][2], "u"), (None, "http://z", "only here", "u")]
    return [*rows, (600, "http://long", "é\r\n\r\n" * 200_000, "u"), (601, "http://binary", "\x00\x01WARC/1.1\r\n", "u")]


def test_round_trip(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write(pages, path, records_per_file=7, bytes_per_file=1 << 12)
    assert len(list((tmp_path / "archives").glob("part-*"))) > 15
    back = warc.read(spark, path).collect()
    assert len(back) == len(rows)
    payload = {bytes(r["payload"]) for r in back if r["record_type"] == "response"}
    assert payload == {(h or "").encode() for _, _, h, _ in rows}
    got = sorted((tuple(r) for r in warc.query(pages).collect()), key=str)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        data, f = (h or "").encode(), first.get(h or "")
        again = f is not None and (i is None or i > f)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert got == sorted(want, key=str)


def archive(records, dictionary=b"", compressed=False):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    lead = warc.dictionary_frame(zstandard.compress(dictionary) if compressed else dictionary) if dictionary else b""
    return lead + b"".join(packer.compress(r) for r in records)


def test_dictionary_plain_and_compressed():
    records = [warc.record(i, "u", b"some words of a page " * 5, None, "2024-01-01T00:00:00Z") for i in range(3)]
    trained = b"some words of a page WARC/1.1\r\nWARC-Type: response" * 4
    for data in (archive(records), archive(records, trained), archive(records, trained, True)):
        assert [d for _, d in warc.frames(data)] == records
    streamed = zstandard.ZstdCompressor().compressobj()
    unsized = streamed.compress(records[0]) + streamed.flush()
    assert [d for _, d in warc.frames(unsized + archive(records[1:]))] == records


@pytest.mark.parametrize(
    "damage, says",
    [
        (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), "version"),
        (lambda r: r.replace(b"WARC-Date", b"X-Date", 1), "missing"),
        (lambda r: r.replace(b"hello", b"hallo", 1), "digest"),
        (lambda r: r + r, "announced"),
        (lambda r: r[:-1], "announced"),
        (lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"), "digest|announced"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"), "twice"),
        (lambda r: b"", "version"),
    ],
)
def test_damaged_records(damage, says):
    good = warc.record(1, "http://x", b"hello", None, "2024-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"hello"
    with pytest.raises(warc.ArchiveError, match=says):
        warc.parse(damage(good))


def test_damaged_frames(spark, tmp_path):
    good = archive([warc.record(1, "http://x", b"hello", None, "2024-01-01T00:00:00Z")], b"hello words" * 20)
    for bad in (good[:-3], good + b"abc", good + struct.pack("<II", warc.DICTIONARY_MAGIC, 0), good[:12], good.replace(good[-6:], b"\xff" * 6)):
        with pytest.raises(warc.ArchiveError):
            list(map(warc.parse, (d for _, d in warc.frames(bad))))
    (tmp_path / "bad.warc.zst").write_bytes(good[:-3])
    with pytest.raises(Exception, match="bad.warc.zst"):
        warc.read(spark, str(tmp_path)).collect()


def test_empty_table(spark):
    assert warc.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
