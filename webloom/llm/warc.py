"""Zstandard WARC archives: writing with revisits, reading with validation.

An archive is a leading skippable frame that holds the dictionary, itself packed as
a Zstandard frame, then one frame per record: a warcinfo record and the records of
pages.  A frame can be decoded alone with the dictionary, so a record is found by
its offset.

A page is a ``response`` record: an HTTP head and the page in UTF-8 as payload.  Of
pages with equal payloads of some size only the one with the largest id is written
in full; the others are ``revisit`` records with the HTTP head alone, which name it
and the digest of the payload they share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator, Mapping
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import shuffle_partitions
from webloom.session import fresh_path

# -- fixed values of the formats ----------------------------------------------
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGICS = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSIONS = ("WARC/1.0", "WARC/1.1")
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# -----------------------------------------------------------------------------

#: Payloads shorter than this are never revisited.
LEAST_REVISITED = 1000
#: The sample a dictionary is trained on: pages, bytes of each, and its own size.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8_000, 65_536
LEVEL = 6
#: Compressed bytes after which a task begins another archive; a record is never split.
FILE_BYTES = 128_000_000
READ_BYTES = 1 << 16
#: Rows of output a reading task hands on at once, or bytes of payloads.
BATCH_ROWS, BATCH_BYTES = 2_000, 16_000_000

ID_PREFIX = "urn:page:"
MANIFEST = "path string, n_records long, bytes long"
_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string())]
    + [("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
)
RECORD = "path string, offset long, record_id string, record_type string, target_uri string, date string, payload_bytes long, payload_digest string, refers_to string"


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


# -- records ------------------------------------------------------------------


def digest_header(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def digest_hex(value: str) -> tuple[str, str]:
    """(algorithm, hex digits) of a digest header in base 32 or 16."""
    name, _, text = value.partition(":")
    name = name.strip().lower().replace("-", "")
    size = hashlib.new(name).digest_size * 2
    found = text.strip() if len(text.strip()) == size else base64.b32decode(text.strip().upper()).hex()
    if len(found) != size:
        raise ValueError(f"a digest of {len(found)} digits")
    return name, found.lower()


def uri_of(text: str) -> str:
    """A header holds no control characters or blanks: these are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(headers: Mapping[str, str | None], block: bytes) -> bytes:
    """A whole record; headers without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def page_record(page_id: int | None, url: str | None, date: str, length: int, sha1: bytes, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """A response with its payload, or a revisit of page ``refers_to`` without one."""
    revisit = payload is None
    block = http_head(length) + (payload or b"")
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{ID_PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else uri_of(url),
        "WARC-Refers-To": f"<{ID_PREFIX}{refers_to}>" if revisit else None,
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Payload-Digest": digest_header(sha1),
        "WARC-Block-Digest": digest_header(hashlib.sha1(block).digest()),
        "Content-Type": "application/http; msgtype=response",
    }
    return record_bytes(headers, block)


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with a blank goes on with the last."""
    found: dict[str, str] = {}
    last = ""
    for line in lines:
        text = line.decode("utf-8")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        last = name.strip().lower()
        if not colon or not last or name != name.strip():
            raise ValueError(f"no header: {text[:80]!r}")
        found.setdefault(last, value.strip())
    return found


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a decoded frame, which must hold exactly one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the headers")
    version, *lines = head.split(b"\r\n")
    if version.decode("utf-8", "replace") not in VERSIONS:
        raise ValueError(f"no WARC version: {version[:40]!r}")
    headers = _headers(lines)
    missing = [name for name in MANDATORY if not headers.get(name)]
    if missing:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    if not re.fullmatch("[0-9]+", headers["content-length"]):
        raise ValueError(f"content-length {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length}, but {len(rest)} bytes with the end of the record")
    block = rest[:length]
    if "warc-block-digest" in headers:
        name, said = digest_hex(headers["warc-block-digest"])
        if hashlib.new(name, block).hexdigest() != said:
            raise ValueError("the block does not have its digest")
    return headers, block


def payload_of(headers: Mapping[str, str], block: bytes) -> tuple[int, str, bytes]:
    """(length, SHA-1, payload) of a response or a revisit, checked against its headers.

    A revisit has no payload of its own: length and digest are those of the payload it
    shares, as its HTTP head and its digest header say.
    """
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    said = _headers(lines).get("content-length")
    if headers["warc-type"] == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        name, digest = digest_hex(headers.get("warc-payload-digest", ""))
        if name != "sha1" or said is None or not headers.get("warc-refers-to"):
            raise ValueError("a revisit that does not say what it shares")
        return int(said), digest, payload
    if said is not None and int(said) != len(payload):
        raise ValueError(f"HTTP content-length {said}, but a payload of {len(payload)} bytes")
    digest = hashlib.sha1(payload).hexdigest()
    if "warc-payload-digest" in headers:
        name, given = digest_hex(headers["warc-payload-digest"])
        if given != (digest if name == "sha1" else hashlib.new(name, payload).hexdigest()):
            raise ValueError("the payload does not have its digest")
    return len(payload), digest, payload


# -- frames -------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; empty without a dictionary."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=given, write_checksum=True)


def read_frames(file: BinaryIO, path: str = "") -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every frame of an archive, front to back.

    One frame and one block of the file are held at a time.
    """
    held, at, unpack = b"", 0, zstandard.ZstdDecompressor()

    def more() -> bool:
        nonlocal held
        found = file.read(READ_BYTES)
        held += found
        return bool(found)

    while held or more():
        while len(held) < 8 and more():
            pass
        magic = int.from_bytes(held[:4], "little")
        if magic in SKIPPABLE_MAGICS and len(held) >= 8:
            size = 8 + int.from_bytes(held[4:8], "little")
            while len(held) < size and more():
                pass
            if len(held) < size:
                raise BadArchive(f"{path}: a skippable frame at {at} is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(held[8:size], path))
            held, at = held[size:], at + size
            continue
        if held[:4] != FRAME_MAGIC:
            raise BadArchive(f"{path}: no frame at {at}")
        frame, parts, start = unpack.decompressobj(), [], at
        try:
            while not frame.eof:
                if not held and not more():
                    raise BadArchive(f"{path}: the frame at {start} is cut off")
                parts.append(frame.decompress(held))
                rest = frame.unused_data if frame.eof else b""
                at, held = at + len(held) - len(rest), rest
        except zstandard.ZstdError as error:
            raise BadArchive(f"{path}: the frame at {start} cannot be decoded: {error}") from error
        yield start, b"".join(parts)


def _dictionary(raw: bytes, path: str) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading frame, packed or plain."""
    try:
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        return zstandard.ZstdCompressionDict(raw)
    except zstandard.ZstdError as error:
        raise BadArchive(f"{path}: the dictionary cannot be read: {error}") from error


def read_records(file: BinaryIO, path: str = "") -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record, validated."""
    for at, raw in read_frames(file, path):
        try:
            yield at, *parse_record(raw)
        except ValueError as error:
            raise BadArchive(f"{path}: the record at {at}: {error}") from error


# -- jobs ---------------------------------------------------------------------


def train_dictionary(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the first bytes of some pages; empty if they are too few.

    The sample is bounded by its parameters.  It decides how small records get and
    nothing else: every page is written whole.
    """
    body = F.encode(F.substring(pages[html_col].cast("string"), 1, sample_bytes), "UTF-8")
    # About twice the rows asked for pass the filter, so no task sends more than a few.
    share = 2 * sample_pages / max(1, pages.count())
    drawn = F.pmod(F.xxhash64(*[pages[c] for c, kind in pages.dtypes if kind in ("bigint", "int", "string")]), F.lit(1 << 30)) < int(min(1, share) * (1 << 30))
    some = pages.where((F.length(pages[html_col]) > 0) & drawn).select(body.alias("body")).limit(sample_pages)
    samples = [bytes(r["body"])[:sample_bytes] for r in some.collect()]  # bounded by the parameters
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(
    pages: DataFrame,
    path: str,
    dictionary: bytes = b"",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    least_revisited: int = LEAST_REVISITED,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for every page below ``path``; returns the manifest of archives.

    Of pages with the same payload (by SHA-1 and length) of at least
    ``least_revisited`` bytes those of the largest id are responses, the others revisit
    them; if all their ids are null, all are responses.  A null page is an empty one, a
    repeated row is a record again, a null url has no target header, and blanks and
    control characters of a url come out percent-encoded.  An empty table gives an
    empty manifest.  Further columns of ``pages`` may have any name.

    Pages are packed into finished frames where they are read, so only these are
    shuffled, by digest, to learn of repeated payloads; a payload that fills a large
    share of the table is split over tasks.  An attempt of a task writes archives of
    its own name, and the manifest names those that count.
    """
    spark = pages.sparkSession
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    digested = rows.select("page_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("digest"))
    found = digested.where(F.col("n_bytes") >= least_revisited).groupBy(F.concat_ws(":", "digest", "n_bytes").alias("key"))
    groups_at = fresh_path(spark, "repeated-payloads")
    found.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").write.parquet(groups_at)
    groups = spark.read.schema("key string, first long, n long").parquet(groups_at)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = compressor(dictionary)
        for batch in batches:
            keys, frames, lengths, digests = batch.column("page_id").to_pylist(), [], [], []
            urls, payloads = batch.column("url").to_pylist(), batch.column("payload")
            for key, url, payload in zip(keys, urls, payloads):
                body = payload.as_py()
                sha1 = hashlib.sha1(body)
                frames.append(squeeze.compress(page_record(key, url, date, len(body), sha1.digest(), body)))
                lengths.append(len(body))
                digests.append(f"{sha1.hexdigest()}:{len(body)}")
            columns = [batch.column("page_id"), batch.column("url"), pa.array(digests, pa.string()), pa.array(lengths, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "key", "n_bytes", "frame"])

    packed = rows.mapInArrow(pack, "page_id long, url string, key string, n_bytes long, frame binary")
    # A payload with more than this many rows is dealt over several tasks.  At most four
    # payloads a partition have so many, so they can be broadcast.
    most = (groups.agg(F.sum("n")).first()[0] or 0) // (4 * shuffle_partitions(spark)) + 1_000
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(groups.where(F.col("n") > most).select("key", parts.alias("parts")))
    place = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), "parts"), F.lit(0)).cast("int")
    dealt = packed.join(hot, "key", "left").withColumn("part", place).drop("parts")
    spread = groups.select("key", "first", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, parts).otherwise(1) - 1)).alias("part"))
    joined = dealt.join(spread, ["key", "part"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        squeeze, attempt = compressor(dictionary), uuid.uuid4().hex
        number = TaskContext.get().partitionId()
        out, held, n, files = None, 0, 0, []

        def end() -> None:
            nonlocal out
            if out:
                out.close()
                files.append((f"{path}/{name}", n, held))
                out = None

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "key", "n_bytes", "first"))
            for key, url, digest, length, first, frame in zip(*columns, batch.column("frame")):
                raw = frame.as_py()
                if first is not None and key != first:
                    raw = squeeze.compress(page_record(key, url, date, length, bytes.fromhex(digest[:40]), None, first))
                if out and held >= file_bytes:
                    end()
                if not out:
                    name = f"part-{number:06d}-{len(files):04d}-{attempt}.warc.zst"
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    info = record_bytes(
                        {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"},
                        b"format: WARC File Format 1.1\r\n",
                    )
                    lead = dictionary_frame(dictionary) + squeeze.compress(info)
                    out.write(lead)
                    held, n = len(lead), 0
                out.write(raw)
                held, n = held + len(raw), n + 1
        end()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*files)], schema=_MANIFEST)

    manifest = f"{path}/manifest"
    joined.select("page_id", "url", "key", "n_bytes", "first", "frame").mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The responses and revisits of ``archives(path)``, every record of them validated.

    A row has the archive and offset of its record, its headers, and length and SHA-1
    (bare lower-case hex) of the full payload, with ``payloads`` also the payload (null
    for a revisit).  Records of other types are validated and left out.  A record or
    archive that breaks the format ends the job with ``BadArchive``, which names the
    place.  No archives give no rows.
    """
    spark = archives.sparkSession
    fields = pa.schema([*_RECORD, ("payload", pa.binary())]) if payloads else _RECORD

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(name, compression=None) as file:
                    for at, headers, block in read_records(file, path):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        try:
                            length, digest, payload = payload_of(headers, block)
                        except ValueError as error:
                            raise BadArchive(f"{path}: the record at {at}: {error}") from error
                        row = (path, at, headers["warc-record-id"].strip("<>"), kind, headers.get("warc-target-uri"), headers["warc-date"])
                        refers_to = headers["warc-refers-to"].strip("<>") if kind == "revisit" else None
                        rows.append((*row, length, digest, refers_to, *([payload if kind == "response" else None] if payloads else [])))
                        size += len(payload) if payloads else 0
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(rows, fields)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, fields)

    dealt = archives.select("path").repartition(shuffle_partitions(spark), "path")
    return dealt.mapInArrow(read, RECORD + (", payload binary" if payloads else ""))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), fields)], schema=fields)


def unresolved(records: DataFrame) -> DataFrame:
    """What revisits refer to and no response is: (refers_to, payload_digest, payload_bytes).

    Revisits of one payload are combined first, so a page that is revisited by a large
    share of the table is looked up once.
    """
    wanted = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    held = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes")
    return wanted.join(held, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def round_trip(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives below ``path``, read them back and check every revisit.

    The records are as of ``read_archives``, stored beside the archives.
    """
    spark: SparkSession = pages.sparkSession
    dictionary = train_dictionary(pages, html_col)
    manifest = write_archives(pages, path, dictionary, id_col, url_col, html_col)
    read_archives(manifest).write.parquet(f"{path}/records")
    records = spark.read.schema(RECORD).parquet(f"{path}/records")
    lost = unresolved(records).first()
    if lost:
        raise BadArchive(f"no response for a revisit of {lost['refers_to']}")
    return records


def page_of(record_id: str) -> Column:
    """The page id in a column of record ids of ``write_archives``; null for a page without one."""
    return F.expr(f"try_cast(substring({record_id}, {len(ID_PREFIX) + 1}) as bigint)")
