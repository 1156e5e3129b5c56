"""Containers of other writers: several tracks, compact sizes, and bytes that are no container."""

import random
import struct

import pytest

from labelmill.llm import media
from labelmill.llm.media import box, full_box


def table(kind, code, *rows):
    return full_box(kind, struct.pack(">I", len(rows)), *(struct.pack(code, *r) if isinstance(r, tuple) else struct.pack(code, r) for r in rows))


def trak(handler, codec, sizes, offset, keys=None, extra=(), wide=False):
    """A track whose samples stand in one chunk."""
    parts = [
        full_box(b"stsd", struct.pack(">I", 1), box(codec, bytes(28))),
        table(b"stts", ">II", (len(sizes), 5)),
        table(b"stsc", ">III", (1, len(sizes), 1)),
        full_box(b"stsz", struct.pack(">II", 0, len(sizes)), *(struct.pack(">I", n) for n in sizes)),
        table(b"co64", ">Q", offset) if wide else table(b"stco", ">I", offset),
        *([table(b"stss", ">I", *keys)] if keys is not None else []),
        *extra,
    ]
    return box(b"trak", box(b"mdia", full_box(b"mdhd", struct.pack(">IIIII", 0, 0, 10, 5 * len(sizes), 0)), full_box(b"hdlr", struct.pack(">I4s12x", 0, handler), b"\0"), box(b"minf", box(b"stbl", *parts))))


HEAD = box(b"ftyp", b"isom", bytes(4))


def two_tracks():
    def whole(first):
        sound = trak(b"soun", b"mp4a", [3] * 40, first)
        pictures = trak(b"vide", b"avc1", [10, 20, 30], first + 120, keys=[1, 3], wide=True)
        return box(b"moov", sound, pictures)

    body = bytes(range(180))
    first = len(HEAD) + len(whole(0)) + 8
    return HEAD + whole(first) + box(b"mdat", body), first


def test_each_track_has_its_own_tables():
    data, first = two_tracks()
    sound, pictures = media.tracks(data)
    assert (sound.handler, sound.codec, len(sound.keys)) == ("soun", "mp4a", 40)
    assert sound.key_ranges()[:2].tolist() == [[first, first + 3], [first + 3, first + 6]]
    assert (pictures.handler, pictures.codec) == ("vide", "avc1")
    assert pictures.key_ranges().tolist() == [[first + 120, first + 130], [first + 150, first + 180]]
    assert media.probe(data).codec == "avc1" and media.probe(data).seconds() == 1.5
    assert sound.stored(data) == bytes(range(120)) and pictures.stored(data) == bytes(range(120, 180))


def test_columns_of_tracks(spark):
    data, first = two_tracks()
    rows = spark.createDataFrame([(1, data), (2, b"x"), (3, None), (None, data)], "doc_id long, media binary")
    got = media.media_tracks(rows).collect()
    assert sorted((r.doc_id or 0, r.track, r.codec, r.samples, r.keys) for r in got) == [(k, t, c, n, m) for k in (0, 1) for t, c, n, m in ((0, "mp4a", 40, 40), (1, "avc1", 3, 2))]
    keys = media.key_samples(rows).where("doc_id = 1 AND track = 1").orderBy("sample").collect()
    assert [(r.sample, r.time, r.first_byte, r.last_byte) for r in keys] == [(0, 0, first + 120, first + 130), (2, 10, first + 150, first + 180)]


def test_compact_sizes():
    for bits, packed in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, struct.pack(">3H", 1, 2, 3))):
        body = struct.pack(">III", 0, bits, 3) + packed
        sizes = media._sizes(body, {b"stz2": (0, len(body))})
        assert sizes.tolist() == [1, 2, 3]


def nested(depth, kind):
    data = b""
    for _ in range(depth):
        data = box(kind, data)
    return data


def hostile():
    data, first = two_tracks()
    yield from (nested(3000, kind) for kind in (b"moov", b"trak", b"mdia", b"stbl"))
    yield from (HEAD + nested(3000, kind) for kind in (b"moov", b"free"))
    huge = struct.pack(">I", 2**32 - 1)
    for kind in (b"stts", b"stsz", b"stsc", b"stco", b"co64", b"stss", b"stsd"):
        at = data.index(kind)
        for skip in (8, 12, 16, 20):
            yield data[: at + skip] + huge + data[at + skip + 4 :]
    # A size for all samples, and very many of them.
    at = data.index(b"stsz")
    yield data[: at + 8] + struct.pack(">II", 1, 2**32 - 1) + data[at + 16 :]
    for order in ((2, 1), (1, 1), (0, 5), (9, 1)):
        rows = table(b"stsc", ">III", *((c, 1, 1) for c in order))
        yield HEAD + box(b"moov", trak(b"vide", b"avc1", [1, 1], 0)).replace(table(b"stsc", ">III", (1, 2, 1)), rows)
    for at in range(0, len(data), 7):
        yield data[:at]
    rng = random.Random(4)
    for _ in range(3000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad) - 180)] = rng.choice((0, 1, 0x7F, 0x80, 0xFF, rng.randrange(256)))
        yield bytes(bad)


def test_no_bytes_make_the_reader_fail_otherwise():
    bad = good = 0
    for data in hostile():
        try:
            for track in media.tracks(data):
                assert len(track.stored(data)) <= len(data) * 64 and len(track.key_ranges()) == len(track.keys)
            good += 1
        except media.MediaError:
            bad += 1
    assert bad > 500 and good > 100


def test_hostile_rows_are_errors_not_crashes(spark):
    rows = list(hostile())[:60] + [b"", None, media.mux(bytes(64))]
    got = media.media_features(spark.createDataFrame([(k, 0, d) for k, d in enumerate(rows)], "doc_id long, n_bytes long, media binary")).collect()
    assert len(got) == len(rows) and got[-1].error is None and sum(r.error is not None for r in got) > 30


def test_out_of_order_runs():
    for rows in (((2, 1, 1), (1, 1, 1)), ((1, 1, 1), (1, 1, 1)), ((1, 1, 1), (9, 1, 1)), ((0, 1, 1), (2, 1, 1))):
        bad = table(b"stsc", ">III", *rows)
        stbl = box(b"stbl", full_box(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(28))), table(b"stts", ">II", (2, 5)), bad, full_box(b"stsz", struct.pack(">II", 1, 2)), table(b"stco", ">I", 8, 9))
        data = HEAD + box(b"moov", box(b"trak", box(b"mdia", full_box(b"mdhd", bytes(20)), box(b"minf", stbl))))
        with pytest.raises(media.MediaError):
            media.probe(data)


def test_tables_of_tracks_and_key_samples_stand_any_rows(spark):
    long_one = bytes(1 << 20)
    rows = [(1, media.mux(b"a" * 64 * 40), "x"), (1, media.mux(b"a" * 64 * 40), "y"), (None, media.mux(b""), None), (2, None, "x"), (3, b"\0\0\0\3free", "x"), (4, b"", "x"), (5, media.mux(long_one), "x")]
    df = spark.createDataFrame(rows, "doc_id int, media binary, track string")
    found = media.media_tracks(df).collect()
    assert sorted((r.doc_id or 0, r.track, r.samples) for r in found) == [(0, 0, 0), (1, 0, 40), (1, 0, 40), (5, 0, len(long_one) // 64)]
    keys = media.key_samples(df).collect()
    assert sorted((r.doc_id, r.sample) for r in keys if r.doc_id == 1) == sorted([(1, k) for k in (0, 16, 32)] * 2)
    assert {r.doc_id for r in keys} == {1, 5} and sum(r.doc_id == 5 for r in keys) == len(long_one) // 64 // 16
    assert all(r.last_byte - r.first_byte == 64 for r in keys)
    none = df.where("false")
    assert media.media_tracks(none).count() == media.key_samples(none).count() == 0
