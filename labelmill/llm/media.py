"""ISO media containers in a binary column: write a track, and read what the boxes say.

The reader walks nested boxes, decodes each track's own sample tables (sizes, chunks, times, key
samples) and gives codec, duration and the byte ranges of key samples. It never decodes
payloads; the stored bytes of a track are the concatenation of its samples' ranges. Counts are
held against the box and the file before anything is built from them, so no bytes make the
reader take more memory than a small multiple of them, and whatever is wrong is a MediaError.
Movie fragments are not read: such a track has the samples of its tables only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm import textscan as ts

#: Handlers in order of choice where a file has several tracks: pictures, sound.
PREFERRED = (b"vide", b"soun")
BLOCK = 64
SAMPLES_PER_CHUNK = 64
KEY_EVERY = 16
RATE = 8000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, block: int = BLOCK) -> bytes:
    """A file with one 8-bit mono audio track, whose samples are blocks of the payload.

    The payload's length must be a multiple of ``block``. Every 16th block is a key sample.
    """
    samples = len(payload) // block
    chunks = -(-samples // SAMPLES_PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = len(payload)
    full, rest = divmod(samples, SAMPLES_PER_CHUNK)
    runs = ([(1, SAMPLES_PER_CHUNK, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (SAMPLES_PER_CHUNK * block)
        wide = bool(chunks) and int(offsets[-1]) >= 1 << 32
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, samples, block) if samples else struct.pack(">I", 0)),
            full_box(b"stss", struct.pack(">I", -(-samples // KEY_EVERY)), np.arange(1, samples + 1, KEY_EVERY, dtype=">u4").tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", block, samples)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">HH", 0x55C4, 0), version=1),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full_box(b"smhd", struct.pack(">HH", 0, 0)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table),
        )
        movie = full_box(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, duration), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
        track = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), struct.pack(">8xHHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        return box(b"moov", movie, box(b"trak", track, media))

    size = len(moov(0))
    header = 16 if len(payload) + 8 >= 1 << 32 else 8
    index = moov(len(head) + size + header)
    if len(index) != size:
        index = moov(len(head) + len(index) + header)
    return b"".join([head, index, box(b"mdat", payload)])


class MediaError(ValueError):
    """The bytes are not a well-formed container of the supported kind."""


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """(kind, first byte of the body, end) of each box in a range."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise MediaError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError("cut box header")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise MediaError(f"box {kind!r} has a wrong size")
        yield kind, body, start + size
        start += size


def _inside(data: bytes, at: tuple[int, int], kind: bytes) -> tuple[int, int]:
    """Body and end of the first box of a kind in a range."""
    for found, body, stop in boxes(data, *at):
        if found == kind:
            return body, stop
    raise MediaError(f"no {kind!r}")


def _read(code: str, data: bytes, at: tuple[int, int], skip: int = 0) -> tuple:
    """Numbers at a place of a box, all inside it."""
    if at[0] + skip + struct.calcsize(code) > at[1]:
        raise MediaError("cut box")
    return struct.unpack_from(code, data, at[0] + skip)


def _table(data: bytes, at: tuple[int, int] | None, fields: int, skip: int = 8, code: str = ">u4") -> np.ndarray:
    """Rows of a full box's table, whose length stands before them."""
    if at is None:
        return np.zeros((0, fields), np.int64)
    (count,) = _read(">I", data, at, skip - 4)
    width = np.dtype(code).itemsize * fields
    if at[0] + skip + count * width > at[1]:
        raise MediaError("cut table")
    return np.frombuffer(data, code, count * fields, at[0] + skip).astype(np.int64).reshape(count, fields)


@dataclass
class Track:
    """What the boxes say of one track. duration is None if the file leaves it open."""

    handler: str
    codec: str
    timescale: int
    duration: int | None
    sizes: np.ndarray
    offsets: np.ndarray
    durations: np.ndarray
    keys: np.ndarray

    def seconds(self) -> float:
        return self.duration / self.timescale if self.duration and self.timescale else 0.0

    def key_ranges(self) -> np.ndarray:
        """(first byte, last byte + 1) of each key sample."""
        return np.stack([self.offsets[self.keys], self.offsets[self.keys] + self.sizes[self.keys]], axis=1)

    def stored(self, data: bytes) -> bytes:
        """The samples' bytes, in order; neighbouring ranges are read as one."""
        if not len(self.sizes):
            return b""
        ends = self.offsets + self.sizes
        new = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        first, last = np.append(0, new), np.append(new, len(ends)) - 1
        return b"".join(data[a:b] for a, b in zip(self.offsets[first].tolist(), ends[last].tolist()))


def _sizes(data: bytes, found: dict) -> np.ndarray:
    """Sample sizes, from either of their two boxes."""
    if b"stsz" in found:
        size, count = _read(">II", data, found[b"stsz"], 4)
        if not size:
            return _table(data, found[b"stsz"], 1, skip=12)[:, 0]
        if size * count > len(data):
            raise MediaError("more samples than bytes")
        return np.full(count, size, np.int64)
    if b"stz2" not in found:
        raise MediaError("no b'stsz'")
    bits, count = _read(">4xII", data, found[b"stz2"])
    body, stop = found[b"stz2"][0] + 12, found[b"stz2"][1]
    if bits & 0xFF not in (4, 8, 16) or body + (count * (bits & 0xFF) + 7) // 8 > stop:
        raise MediaError("cut table")
    if bits & 0xFF == 4:
        pairs = np.frombuffer(data, np.uint8, (count + 1) // 2, body)
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:count].astype(np.int64)
    return np.frombuffer(data, ">u1" if bits & 0xFF == 8 else ">u2", count, body).astype(np.int64)


def _track(data: bytes, trak: tuple[int, int]) -> Track:
    media = _inside(data, trak, b"mdia")
    table = _inside(data, _inside(data, media, b"minf"), b"stbl")
    found: dict[bytes, tuple[int, int]] = {}
    for kind, body, stop in boxes(data, *table):
        found.setdefault(kind, (body, stop))
    head = _inside(data, media, b"mdhd")
    long = _read(">B", data, head)[0] == 1
    timescale, duration = _read(">IQ" if long else ">II", data, head, 20 if long else 12)
    unknown = duration == (1 << (64 if long else 32)) - 1
    if duration >= 1 << 63 and not unknown:
        raise MediaError("duration out of range")
    handler = next((_read("4s", data, (body, stop), 8)[0] for kind, body, stop in boxes(data, *media) if kind == b"hdlr"), b"")
    entries = found.get(b"stsd")
    codec = next((kind for kind, _, _ in boxes(data, entries[0] + 8, entries[1])), None) if entries else None
    if codec is None:
        raise MediaError("no sample entry")

    sizes = _sizes(data, found)
    chunks = _table(data, found[b"co64"], 1, code=">u8")[:, 0] if b"co64" in found else _table(data, found.get(b"stco"), 1)[:, 0]
    if len(chunks) and (chunks.min() < 0 or chunks.max() > len(data)):
        raise MediaError("chunks lie outside the file")
    runs = _table(data, found.get(b"stsc"), 3)
    tops = np.append(runs[:, 0] - 1, len(chunks))
    if tops[0] != 0 or (np.diff(tops) < 0).any() or (np.diff(tops[:-1]) == 0).any():
        raise MediaError("runs of chunks out of order")
    per_chunk = np.repeat(runs[:, 1], np.diff(tops))
    if per_chunk.sum() != len(sizes):
        raise MediaError("chunks and samples differ in number")
    before = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    top = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[chunk] + before - before[top[chunk]] if len(sizes) else sizes
    if len(sizes) and (offsets + sizes).max() > len(data):
        raise MediaError("samples lie outside the file")
    times = _table(data, found.get(b"stts"), 2)
    if times[:, 0].sum() != len(sizes):
        raise MediaError("times and samples differ in number")
    keys = _table(data, found[b"stss"], 1)[:, 0] - 1 if b"stss" in found else np.arange(len(sizes))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise MediaError("key samples outside the track")
    name = lambda x: x.decode("latin-1").strip(" \0")
    return Track(name(handler), name(codec), timescale, None if unknown else duration, sizes, offsets, np.repeat(times[:, 1], times[:, 0]), keys)


def tracks(data: bytes) -> list[Track]:
    """All tracks of a container; raises MediaError where its boxes contradict each other."""
    top = (0, len(data))
    _inside(data, top, b"ftyp")
    found = [_track(data, (body, stop)) for kind, body, stop in boxes(data, *_inside(data, top, b"moov")) if kind == b"trak"]
    if not found:
        raise MediaError("no b'trak'")
    return found


def probe(data: bytes) -> Track:
    """The main track of a container: the first with pictures, else with sound, else the first."""
    found = tracks(data)
    return next((t for kind in PREFERRED for t in found if t.handler.encode("latin-1") == kind), found[0])


def padded(text: bytes, block: int = BLOCK) -> bytes:
    """The bytes with zeros up to a positive multiple of the block."""
    return text + bytes(-len(text) % block if text else block)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as UTF-8, padded, in a container.

    Repeated rows are given each, a null doc_id stays null, other columns don't matter; an empty
    table gives no rows. A text of over 4 GB would get 64-bit boxes; Arrow holds up to 2 GB.
    """

    def work(batches):
        for batch in batches:
            body, offs = ts.binary_parts(batch.column(1))
            for first in range(0, batch.num_rows, 512):
                last = min(first + 512, batch.num_rows)
                media = [mux(padded(body[offs[i] : offs[i + 1]].tobytes())) for i in range(first, last)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(offs[first : last + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Features of a media column: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and error for bytes that are no container.

    payload_* and tail_crc32 (of the last 64 bytes) are of the main track's stored samples. feature names
    codec, duration, number of samples and key samples, and the CRC of the key samples' byte
    ranges. Null or malformed media, whatever the bytes, give nulls and an error; repeated rows are
    given each; an empty table gives no rows; a null doc_id stays null, other columns don't matter.
    A task holds one row's payload besides its batch.
    """

    def work(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2):
                data = data.as_py()
                try:
                    if data is None:
                        raise MediaError("null")
                    track = probe(data)
                    stored = track.stored(data)
                    ranges = zlib.crc32(track.key_ranges().astype("<i8").tobytes())
                    feature = f"codec={track.codec};seconds={track.seconds():.6f};samples={len(track.sizes)};keys={len(track.keys)};key_ranges={ranges:08x}"
                    rows.append((len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature, None))
                except MediaError as e:
                    rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, str(e)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media_tracks(media: DataFrame) -> DataFrame:
    """(doc_id, track, handler, codec, seconds, samples, keys) of each track of a media column, numbered from 0.

    Null or bad media give none, nor does an empty table; repeated rows are given each, a null
    doc_id stays null, other columns don't matter.
    """

    def work(batches):
        for batch in batches:
            rows = []
            for i, data in enumerate(batch.column(1)):
                try:
                    rows += [(i, k, t.handler, t.codec, t.seconds(), len(t.sizes), len(t.keys)) for k, t in enumerate(tracks(data.as_py() or b""))]
                except MediaError:
                    continue
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            owner, *rest = (pa.array(c, k) for c, k in zip(columns, kinds))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *rest], names=["doc_id", "track", "handler", "codec", "seconds", "samples", "keys"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(work, "doc_id long, track int, handler string, codec string, seconds double, samples long, keys long")


def key_samples(media: DataFrame) -> DataFrame:
    """(doc_id, track, sample, time, first_byte, last_byte) of each key sample of a media column.

    Samples are found by the tables of their own track; last_byte is the first one behind a
    sample. Null or bad media give none, nor does an empty table; repeated rows are given each, a
    null doc_id stays null, other columns don't matter. No payload is decoded or copied, so rows
    stay small however long the media.
    """

    def work(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                try:
                    found = tracks(data.as_py() or b"")
                except MediaError:
                    continue
                for k, track in enumerate(found):
                    ranges, times = track.key_ranges(), (np.cumsum(track.durations) - track.durations)[track.keys]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(ranges), i))), pa.array(np.full(len(ranges), k, np.int32)), pa.array(track.keys), pa.array(times), pa.array(ranges[:, 0]), pa.array(ranges[:, 1])], names=["doc_id", "track", "sample", "time", "first_byte", "last_byte"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(work, "doc_id long, track int, sample long, time long, first_byte long, last_byte long")
