"""WARC archives compressed with Zstandard, one frame per record, with a dictionary in front.

An archive is one binary value: a skippable frame that holds the dictionary, then a frame for
each record. Each task trains the dictionary of an archive on slices of that archive's own
records; what is too little to train on is itself the dictionary's content. The reader loads
the dictionary, finds each frame's end from its block headers, decodes one frame per record,
and checks headers, lengths, and those digests whose algorithm it knows. It reads records of
any type and writer. Archives are rows of a table, so Spark writes and commits them; files are
read by Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.session import materialize

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"

ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
TRAIN_BYTES = 1 << 20
SAMPLE_BYTES = 4096
#: A record is not larger than Arrow can hold.
MOST_BYTES = (1 << 31) - 1
PIECE_BYTES = 1 << 20
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record is malformed."""


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """A response record, or a revisit, which leaves the payload out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if revisit else payload)
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE_URN}{page_id}>",
        f"WARC-Target-URI: {re.sub('[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        heads[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on slices of the records, evenly spread; the slices themselves where they are too few or too even."""
    slices = [r[k : k + SAMPLE_BYTES] for r in records for k in range(0, len(r), SAMPLE_BYTES)]
    slices = slices[:: max(1, len(slices) * SAMPLE_BYTES // TRAIN_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, slices, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(slices)[-DICTIONARY_BYTES:].rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of records: their dictionary, then a frame for each."""
    dictionary = _dictionary(records)
    writer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_FRAME, len(dictionary.as_bytes())) + dictionary.as_bytes()
    return head + b"".join(map(writer.compress, records))


def frame_end(data: bytes, start: int) -> int:
    """Where the Zstandard frame at start ends, from its block headers."""
    try:
        at = start + zstandard.frame_header_size(data[start : start + 18])
        frame = zstandard.get_frame_parameters(data[start : start + 18])
        checksum = frame.has_checksum
        if MOST_BYTES < frame.content_size < zstandard.CONTENTSIZE_ERROR - 1:
            raise WarcError("record too large")
    except zstandard.ZstdError as e:
        raise WarcError(f"frame header: {e}") from e
    while True:
        if at + 3 > len(data):
            raise WarcError("cut frame")
        head = int.from_bytes(data[at : at + 3], "little")
        if head >> 1 & 3 == 3:
            raise WarcError("reserved block")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise WarcError("cut frame")
    return at


def _decoded(reader: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """A frame's content, in pieces: it may be longer than a record can be, whatever the frame says of it."""
    parts, size = [], 0
    with reader.stream_reader(frame) as stream:
        while piece := stream.read(PIECE_BYTES):
            size += len(piece)
            if size > MOST_BYTES:
                raise WarcError("record too large")
            parts.append(piece)
    return b"".join(parts)


def frames(data: bytes):
    """The records of an archive, each from its own frame."""
    at, dictionary = 0, None
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError("cut frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise WarcError("cut skippable frame")
            if magic == DICTIONARY_FRAME and at == 0:
                body = data[8 : 8 + size]
                try:
                    if body[:4] == struct.pack("<I", ZSTD_FRAME):
                        body = _decoded(zstandard.ZstdDecompressor(), body)
                    dictionary = zstandard.ZstdCompressionDict(body)
                    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
                except zstandard.ZstdError as e:
                    raise WarcError(f"dictionary: {e}") from e
            at += 8 + size
            continue
        if magic != ZSTD_FRAME:
            raise WarcError("no Zstandard frame")
        end = frame_end(data, at)
        try:
            record = _decoded(reader, data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame: {e}") from e
        yield record
        at = end


def _page(record_id: str | None) -> int | None:
    """The page of an id that this module wrote."""
    own = re.fullmatch(rf"<{PAGE_URN}(-?\d+)>", record_id or "")
    return int(own[1]) if own else None


def _agrees(stated: str, data: bytes) -> bool:
    """Whether a digest, as algorithm:value in hex, base32 or base64, is that of data; unknown algorithms pass."""
    name, _, value = stated.partition(":")
    try:
        digest = hashlib.new(name.strip().lower().replace("-", ""), data, usedforsecurity=False).digest()
    except (ValueError, TypeError):
        return True
    value = value.strip()
    if value.lower() == digest.hex():
        return True
    coded = base64.b32encode(digest).decode().rstrip("="), base64.b64encode(digest).decode().rstrip("=")
    return value.rstrip("=").upper() == coded[0] or value.rstrip("=").replace("-", "+").replace("_", "/") == coded[1]


def _headers(lines: list[str]) -> dict[str, str]:
    """Header values by lower-case name; a line that begins with white space goes on with the one before."""
    found: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header line {line[:40]!r}")
        name = name.strip().lower()
        found.setdefault(name, value.strip())
    return found


def _unchunked(body: bytes) -> bytes | None:
    """A body in chunked transfer coding without it; None if it isn't one."""
    parts, at = [], 0
    while (line := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(body, at)) is not None:
        size = int(line[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[line.end() : line.end() + size])
        at = line.end() + size + 2
    return None


def parse_record(data: bytes) -> dict:
    """The parts of a record; raises WarcError where headers, lengths or digests are wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/\d\.\d+", lines[0]):
        raise WarcError("no WARC header")
    heads = _headers(lines[1:])
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - heads.keys()
    if missing:
        raise WarcError(f"no {', '.join(sorted(missing))}")
    if not re.fullmatch(r"\d{1,18}", heads["content-length"]) or len(rest) != int(heads["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the block")
    record_id, kind, block = heads["warc-record-id"], heads["warc-type"].lower(), rest[:-4]
    if not re.fullmatch(r"<[^<>\s]+>", record_id):
        raise WarcError("record id")
    if "warc-block-digest" in heads and not _agrees(heads["warc-block-digest"], block):
        raise WarcError("block digest")
    payload, size = block, len(block)
    if heads.get("content-type", "").lower().startswith("application/http") and kind in ("response", "revisit", "request"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(top.decode("latin-1").split("\r\n")[1:])
        size = len(payload)
        stated = http.get("content-length", "")
        chunked = _unchunked(payload) if "chunked" in http.get("transfer-encoding", "").lower() else None
        if kind == "revisit":
            size = int(stated) if re.fullmatch(r"\d{1,18}", stated) else None
        elif stated and "transfer-encoding" not in http and not (stated.isdigit() and int(stated) == size):
            raise WarcError("HTTP Content-Length differs from the payload")
    else:
        chunked = None
    stated = heads.get("warc-payload-digest")
    # Writers take the digest with or without the transfer coding.
    if stated and kind != "revisit" and not any(_agrees(stated, x) for x in (payload, chunked) if x is not None):
        raise WarcError("payload digest")
    refers_to = heads.get("warc-refers-to")
    if kind == "revisit":
        known = re.fullmatch(r"sha-?256:([0-9A-Fa-f]{64})", stated or "")
        digest, payload = known[1].lower() if known else None, None
    else:
        digest = hashlib.sha256(payload).hexdigest()
    return {
        "page_id": _page(record_id),
        "url": heads.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(refers_to),
        "payload": payload,
        "record_id": record_id[1:-1],
        "refers_to_id": refers_to.strip("<>") if refers_to else None,
        "date": heads["warc-date"],
        "stated_digest": stated,
    }


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to) of the pages; payload is null for revisits.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id keeps
    it; others refer to it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest"))
    keys = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("hi")).where("first < hi").select("digest", "first")
    # Only digests meet by digest, in a join that AQE can split; payloads meet their page's own.
    again = keys.join(materialize(firsts, "firsts"), "digest").where("page_id != first").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again"), "first").distinct()
    joined = rows.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again")), "left")
    return joined.select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, archive_size: int = ARCHIVE_BYTES) -> DataFrame:
    """(content binary, records long): archives of about ``archive_size`` bytes before compression.

    Reads page_id, url and html; a null html is an empty payload, a null page_id is written and
    read as null and never referred to; repeated rows are records of their own; other columns
    don't matter; an empty table gives no archives.
    """

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                page_id, url, payload, n, digest, refers_to = row
                held.append(record_bytes(page_id, url, (payload or "").encode("utf-8", "surrogatepass"), n, digest, refers_to))
                size += len(held[-1])
                if size >= archive_size:
                    yield pa.RecordBatch.from_pydict({"content": pa.array([archive_bytes(held)], pa.binary()), "records": [len(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"content": pa.array([archive_bytes(held)], pa.binary()), "records": [len(held)]})

    return with_revisits(pages).mapInArrow(work, "content binary, records long")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives from files (.warc.zst) for ``read_archives``, a row for each; a folder without files gives none.

    A file is one value, which takes its size of a task's memory. Spark's values end at 2 GB, so larger
    files are named in a WarcError before any is read; they must be cut between frames.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > MOST_BYTES - (1 << 20)).select("path").limit(10).collect()
    if large:
        raise WarcError("archives of over 2 GB: " + ", ".join(r[0] for r in large))
    return files.select("content")


RECORD = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("date", pa.string()), ("stated_digest", pa.string()), ("error", pa.string()))


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of a column ``content`` of archives.

    page_id and refers_to (null unless ``write_archives`` made them), url, payload_bytes,
    payload_digest (SHA-256 in hex; of a revisit as stated, if it is one), record_type, payload
    (null for revisits, or if with_payload is false; of records that aren't HTTP the whole
    block), record_id, refers_to_id, date, stated_digest and error. Records of all types are
    given. A malformed record, or the rest of an archive after a malformed frame, is one row
    with an error and nulls. A null or empty content has no records, nor has an empty table;
    equal archives are read each; other columns don't matter.
    """

    def work(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                walk = frames(content.as_py() or b"")
                while True:
                    try:
                        data = next(walk, None)
                        if data is None:
                            break
                        row = parse_record(data) | {"error": None}
                    except WarcError as e:
                        row = dict.fromkeys(k for k, _ in RECORD) | {"error": str(e)}
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(RECORD))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(RECORD))

    return archives.select(F.col("content").cast("binary")).mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string, refers_to_id string, date string, stated_digest string, error string")
