"""Zstandard WARC archives: round trips, revisits and broken archives."""

import hashlib
import io
import os
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from helpers import sorted_rows
from webloom.llm import warc
from webloom.session import fresh_path

LONG = "<p>" + "long page " * 200 + "é</p>"
PAGES = [
    (1, "http://a.example/ one", LONG),
    (9, "http://a.example/9", LONG),
    (4, "http://a.example/4\n", LONG),
    (None, "http://a.example/none", LONG),
    (2, None, "short"),
    (3, "http://b.example/3", "short"),
    (5, "http://b.example/5", None),
    (6, "http://b.example/6", ""),
    (7, "http://b.example/7", "x" * 300_000),
    (8, "http://b.example/8", "日本語 " * 250),
    (8, "http://b.example/8", "日本語 " * 250),
    (10, "http://b.example/10", "\r\n\r\nWARC/1.1\r\n" * 100),
    (11, "http://b.example/11", "a" * 999),
    (12, "http://b.example/12", "a" * 999),
    (None, "http://b.example/13", "b" * 1000),
    (None, "http://b.example/14", "b" * 1000),
]


def pages(spark, rows=PAGES):
    given = [(*row, "path", 1, "frame") for row in rows]
    return spark.createDataFrame(given, "page_id long, url string, html string, path string, n_bytes int, frame string")


def plain(rows, least=warc.LEAST_REVISITED):
    first = {}
    for key, _, html in rows:
        body = (html or "").encode()
        if key is not None and len(body) >= least:
            first[body] = max(first.get(body, key), key)
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        again = body in first and key != first[body]
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def shown(records):
    found = records.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to")
    )
    return sorted_rows(found, *found.columns)


def test_round_trip_equals_plain_version(spark):
    assert shown(warc.round_trip(pages(spark), fresh_path(spark, "warc"))) == plain(PAGES)


def test_payloads_and_headers_come_back(spark):
    manifest = warc.write_archives(pages(spark), fresh_path(spark, "warc"), warc.train_dictionary(pages(spark)))
    found = {(warc_id, kind): (uri, body) for warc_id, kind, uri, body in sorted_rows(
        warc.read_archives(manifest, payloads=True), "record_id", "record_type", "target_uri", "payload")}
    assert bytes(found["urn:page:9", "response"][1]) == LONG.encode()
    assert found["urn:page:4", "revisit"] == ("http://a.example/4%0A", None)
    assert found["urn:page:1", "revisit"][0] == "http://a.example/%20one"
    assert found["urn:page:2", "response"][0] is None
    assert bytes(found["urn:page:10", "response"][1]) == PAGES[11][2].encode()
    assert bytes(found["urn:page:5", "response"][1]) == b""


def test_stored_bytes_are_an_archive(spark):
    """The first bytes of a file are the dictionary's frame, and a record is found by its offset."""
    manifest = warc.write_archives(pages(spark), fresh_path(spark, "warc"), DICTIONARY)
    for row in warc.read_archives(manifest).collect():
        with open(row.path.removeprefix("file:"), "rb") as file:
            raw = file.read()
        assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
        lead = raw[: 8 + int.from_bytes(raw[4:8], "little")]
        _, headers, _ = next(warc.read_records(io.BytesIO(lead + raw[row.offset :])))
        assert headers["warc-record-id"] == f"<{row.record_id}>"


def test_many_files_and_a_hot_payload(spark):
    rows = [(k, f"http://h.example/{k}", LONG if k % 3 else f"page {k} " * 200) for k in range(6000)]
    manifest = warc.write_archives(pages(spark, rows), fresh_path(spark, "warc"), file_bytes=20_000)
    assert manifest.agg(F.sum("n_records")).first()[0] == 6000
    assert manifest.agg(F.max("bytes")).first()[0] < 40_000
    records = warc.read_archives(manifest)
    assert shown(records) == plain(rows)
    assert not warc.unresolved(records).take(1)
    sizes = [r["n"] for r in records.where("record_type = 'revisit'").groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 2


def test_empty_table(spark):
    empty = pages(spark, [])
    assert warc.train_dictionary(empty) == b""
    assert shown(warc.round_trip(empty, fresh_path(spark, "warc"))) == []


def test_unresolved_revisits(spark):
    records = warc.round_trip(pages(spark), fresh_path(spark, "warc"))
    rest = records.where("record_id <> 'urn:page:9'")
    assert [r["refers_to"] for r in warc.unresolved(rest).collect()] == ["urn:page:9"]


# -- the format ---------------------------------------------------------------


def page(body=b"hello", key=1, **changed):
    raw = warc.page_record(key, "http://x.example/", "2024-01-01T00:00:00Z", len(body), hashlib.sha1(body).digest(), body)
    for old, new in changed.values():
        assert old in raw
        raw = raw.replace(old, new)
    return raw


def archive(*records, dictionary=b"", packed=True):
    lead = warc.dictionary_frame(dictionary)
    if dictionary and not packed:
        lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
    squeeze = warc.compressor(dictionary)
    return lead + b"".join(squeeze.compress(r) for r in records)


def read(raw):
    return list(warc.read_records(io.BytesIO(raw)))


DICTIONARY = zstandard.train_dictionary(2000, [page(os.urandom(8).hex().encode(), k) for k in range(400)]).as_bytes()


@pytest.mark.parametrize("packed", [True, False])
def test_the_dictionary_is_loaded_from_the_leading_frame(packed):
    raw = archive(*(page(key=k) for k in range(50)), dictionary=DICTIONARY, packed=packed)
    found = read(raw)
    assert len(found) == 50 and found[7][1]["warc-record-id"] == "<urn:page:7>"
    assert raw[found[7][0] :][:4] == warc.FRAME_MAGIC
    without = raw[8 + int.from_bytes(raw[4:8], "little") :]
    with pytest.raises(warc.BadArchive, match="decoded"):
        read(without)


def test_later_skippable_frames_are_passed_over():
    raw = archive(page()) + struct.pack("<II", 0x184D2A50, 5) + b"notes" + archive(page(key=2))
    assert [h["warc-record-id"] for _, h, _ in read(raw)] == ["<urn:page:1>", "<urn:page:2>"]


@pytest.mark.parametrize(
    ("raw", "said"),
    [
        (archive(page() + page()), "content-length"),
        (archive(page()[:-2]), "content-length"),
        (archive(page(a=(b"WARC/1.1\r\n", b"WARC/3.0\r\n"))), "version"),
        (archive(page(a=(b"WARC-Date: 2024-01-01T00:00:00Z\r\n", b""))), "warc-date"),
        (archive(page(a=(b"hello\r\n\r\n", b"jello\r\n\r\n"))), "block"),
        (archive(page(a=(b"WARC-Date: ", b"WARC-Date "))), "header"),
        (archive(page())[:-3], "cut off"),
        (archive(page()) + b"plain text", "no frame"),
        (b"\x28\xb5", "no frame"),
        (struct.pack("<II", warc.DICTIONARY_MAGIC, 99) + b"short", "cut off"),
    ],
)
def test_broken_archives_are_refused(raw, said):
    with pytest.raises(warc.BadArchive, match=said):
        read(raw)


def test_a_flipped_byte_is_noticed():
    raw = bytearray(archive(page(b"some text " * 50)))
    for at in range(0, len(raw), 7):
        raw[at] ^= 0x10
        with pytest.raises(warc.BadArchive):
            read(bytes(raw))
        raw[at] ^= 0x10


def test_lengths_and_digests_of_payloads():
    headers, block = warc.parse_record(page())
    assert warc.payload_of(headers, block) == (5, hashlib.sha1(b"hello").hexdigest(), b"hello")
    with pytest.raises(ValueError, match="payload of 4"):
        warc.payload_of(headers, block[:-1])
    with pytest.raises(ValueError, match="digest"):
        warc.payload_of(headers, block[:-1] + b"x")
    digest = hashlib.sha1(b"hello")
    assert warc.digest_hex("sha1:" + digest.hexdigest()) == warc.digest_hex(warc.digest_header(digest.digest()))


def test_a_broken_archive_ends_the_job(spark, tmp_path):
    (tmp_path / "bad.warc.zst").write_bytes(archive(page(a=(b"hello\r\n\r\n", b"jello\r\n\r\n"))))
    bad = spark.createDataFrame([(f"file:{tmp_path}/bad.warc.zst",)], "path string")
    with pytest.raises(Exception, match="the block does not have its digest"):
        warc.read_archives(bad).collect()
