import hashlib
import struct

import pytest
import zstandard

from nearword.llm import warc
from nearword.llm.storage import Scratch, open_output

BIG = "<p>" + "x" * 1200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://a/{i}", f"<html>{i} " + "word " * (i % 40)) for i in range(300)]
    rows += [(1000, "http://b/1", BIG), (1001, "http://b 2\n", BIG), (1002, None, BIG), (1003, "u", None), (1004, "u", ""), (1005, "u", "short"), (1006, "u", "short"), (None, "http://n", BIG), (1007, "é", "é" * 600), (1008, "é", "é" * 600), (1002, None, BIG)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    folder = Scratch(spark, "warc").child("a")
    manifest = warc.write(pages, folder, archive_bytes=20_000)
    assert manifest.count() > 2
    got = sorted((tuple(r) for r in warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=str)
    expected = []
    for page, _, html, _ in pages.collect():
        body = (html or "").encode()
        last = {BIG: 1002, "é" * 600: 1008}.get(html) if len(body) >= 1000 else None
        revisit = last is not None and page != last
        expected.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None, None if revisit else bytearray(body)))
    assert got == sorted(expected, key=str)
    assert sorted(r["page_id"] or -1 for r in warc.read_folder(spark, folder, payload=False).collect()) == sorted(x[0] or -1 for x in expected)
    assert warc.read(warc.write(pages.limit(0), folder + "-none")).collect() == []


def archive(*frames):
    return b"".join(frames)


def record(body=b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", kind="response", **more):
    headers = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:0>"), ("WARC-Date", "2024"), *more.items()]
    return warc.record_bytes(headers, body)


def pack(data, **options):
    return zstandard.ZstdCompressor(write_checksum=True, **options).compress(data)


def read_all(data):
    import io

    return [warc.parse(c, "x", o) for o, c in warc.frames(io.BytesIO(data), "x")]


def test_dictionary_leads():
    samples = [b"common header number %d and more of the same text\n" % i * 3 for i in range(500)]
    dictionary = zstandard.train_dictionary(4096, samples)
    for raw in (dictionary.as_bytes(), zstandard.compress(dictionary.as_bytes())):
        data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw + pack(record(), dict_data=dictionary) * 2
        assert [r.block[-2:] for r in read_all(data)] == [b"hi", b"hi"]
    with pytest.raises(warc.WarcError):  # frames that need a dictionary which isn't there
        read_all(pack(record(), dict_data=dictionary))


@pytest.mark.parametrize(
    "data",
    [
        pack(record())[:-3],
        pack(record()) + b"xx",
        b"plain text, not a frame",
        pack(record() * 2),
        pack(record()[:-1]),
        pack(record().replace(b"WARC/1.1", b"WARC/9.9")),
        pack(record().replace(b"WARC-Date: 2024\r\n", b"")),
        pack(record().replace(b"Content-Length: 40", b"Content-Length: 41").replace(b"Content-Length: 39", b"Content-Length: 38")) if b"Content-Length: 40" in record() else pack(record().replace(b"\r\n\r\nHTTP", b"\r\nContent-Length: 1\r\n\r\nHTTP")),
        pack(record().replace(b"WARC-Type: response", b"no colon here")),
        bytes(b ^ (i == 60) for i, b in enumerate(pack(record()))),
        struct.pack("<II", warc.DICTIONARY_MAGIC, 999) + b"short",
    ],
)
def test_broken_archives(data):
    with pytest.raises(warc.WarcError):
        read_all(data)


def test_payload_checks():
    parsed = warc.parse(record())
    assert warc.payload_of(parsed)[0] == b"hi"
    with pytest.raises(warc.WarcError):
        warc.payload_of(warc.parse(record(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nhi")))
    with pytest.raises(warc.WarcError):
        warc.payload_of(warc.parse(record(**{"WARC-Payload-Digest": "sha1:" + "A" * 32})))
    with pytest.raises(warc.WarcError):
        warc.payload_of(warc.parse(record(kind="revisit")))


def test_frames_of_unknown_size_and_large_ones():
    big = record(b"HTTP/1.1 200 OK\r\nContent-Length: 900000\r\n\r\n" + bytes(range(250)) * 3600)
    stream = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    data = pack(big) + stream.compress(record()) + stream.flush() + pack(big)
    assert [len(r.block) for r in read_all(data)] == [900043, 40, 900043]


@pytest.mark.parametrize("page", [0, 5, -3, 2**62])
def test_record_ids(page):
    assert warc.page_of(warc.record_id(page).encode()) == page
    assert warc.page_of(warc.record_id(None, "u").encode()) is None


def test_bad_archive_names_itself(spark):
    uri = Scratch(spark, "warc").child("bad.warc.zst")
    out = open_output(uri)
    out.write(pack(record()) + b"junk")
    out.close()
    with pytest.raises(Exception, match="bad.warc.zst"):
        warc.read(spark.createDataFrame([(uri,)], "file string")).collect()


def test_writer_refuses_what_the_reader_would(spark, monkeypatch):
    from nearword.llm.storage import Scratch

    monkeypatch.setattr(warc, "LARGEST_RECORD", 5000)
    writer = warc.Writer(Scratch(spark, "large").child("x.warc.zst"), "2024-01-01T00:00:00Z")
    writer.add(b"x" * 5000)
    with pytest.raises(warc.WarcError, match="5001"):
        writer.add(b"x" * 5001)
    writer.close()
