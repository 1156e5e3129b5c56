import base64
import hashlib
import random
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from labelmill.llm import warc
from tests.llm.common import same_rows

SCHEMA = "page_id long, url string, html string, payload string, content int"


def pages(spark):
    body = "<html>" + "ähnlich " * 40 + "</html>"
    rows = [(k, f"http://example.com/{k}?a=b c\r\nX: y", f"<p>page {k % 70}</p>" + "text " * (k % 70) + body) for k in range(200)]
    rows += [(900, None, None), (901, "", ""), (902, "u", "short"), (903, "u", "short"), (None, "u", body), (905, "u", body), (905, "u", body), (906, "u", body), (907, "u", "x" * 100), (908, "u", "x" * 100), (909, "u", "y" * 99), (910, "u", "y" * 99), (911, "u", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def test_round_trip(spark):
    df = pages(spark).repartition(3)
    firsts = defaultdict(list)
    rows = df.collect()
    for r in rows:
        firsts[(r.html or "").encode()].append(r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        first = min((k for k in firsts[data] if k is not None), default=None)
        again = len(data) >= 100 and r.page_id is not None and r.page_id != first
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, None if again else data))
    archives = warc.write_archives(df, 200_000)
    got = warc.read_archives(archives)
    assert got.where("error IS NOT NULL").count() == 0
    same_rows([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in got.collect()], want)


def test_files_have_a_dictionary_and_a_frame_per_record(spark, tmp_path):
    content = bytes(warc.write_archives(pages(spark).coalesce(1), 1 << 30).first().content)
    assert content[:4] == b"\x5d\x2a\x4d\x18"
    assert len(list(warc.frames(content))) == 213
    (tmp_path / "a.warc.zst").write_bytes(content)
    assert warc.read_archives(warc.archive_files(spark, str(tmp_path))).count() == 213


def record(kind, block, *more, version="WARC/1.0", content="application/http; msgtype=response"):
    heads = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "WARC-Date: 2020-02-02T00:00:00Z", f"Content-Type: {content}", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def foreign():
    http, body = b"HTTP/1.1 200 OK\r\nServer: x\r\n folded\r\n\r\n", b"<p>hello</p>"
    coded = b"5\r\n<p>he\r\n7;x=y\r\nllo</p>\r\n0\r\n\r\n"
    chunked = http[:-2] + b"Transfer-Encoding: chunked\r\n\r\n"
    info = b"software: something\r\n"
    return [
        record("warcinfo", info, content="application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: example.com\r\n\r\n", content="application/http; msgtype=request"),
        record("response", http + body, f"WARC-Payload-Digest: sha1:{b32(body)}", f"WARC-Block-Digest: SHA-1:{b32(http + body)}", "WARC-Target-URI: http://example.com/"),
        record("response", chunked + coded, f"WARC-Payload-Digest: sha1:{b32(body)}"),
        record("response", chunked + coded, f"WARC-Payload-Digest: sha1:{b32(coded)}", version="WARC/1.1"),
        record("response", http + body, "WARC-Payload-Digest: blake9:abc"),
        record("response", http + body, f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest().upper()}"),
        record("revisit", http, "WARC-Refers-To: <urn:uuid:1>", f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}"),
        record("metadata", b"k: v", content="application/warc-fields"),
        record("conversion", b"plain", content="text/plain"),
    ]


def test_records_of_other_writers(spark):
    got = warc.read_archives(spark.createDataFrame([(warc.archive_bytes(foreign()),)], "content binary")).collect()
    assert [r.error for r in got] == [None] * 10
    assert [r.record_type for r in got] == "warcinfo request response response response response response revisit metadata conversion".split()
    assert {r.record_id for r in got} == {"urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0"} and got[7].refers_to_id == "urn:uuid:1"
    assert bytes(got[2].payload) == b"<p>hello</p>" and got[2].payload_bytes == 12 and got[2].page_id is None
    assert got[7].payload is None and got[7].payload_digest == got[2].payload_digest and bytes(got[9].payload) == b"plain"
    http, body = b"HTTP/1.1 200 OK\r\n\r\n", b"<p>hello</p>"
    wrong = [record("response", http + body, f"WARC-Payload-Digest: sha1:{b32(b'x')}"), record("response", http + body, f"WARC-Block-Digest: sha1:{b32(b'x')}"), record("response", http + body).replace(b"<urn:uuid", b"urn:uuid")]
    bad = warc.read_archives(spark.createDataFrame([(warc.archive_bytes([w]),) for w in wrong], "content binary")).collect()
    assert sorted(r.error for r in bad) == ["block digest", "payload digest", "record id"]


@pytest.mark.parametrize("count, size", [(1, 10), (2, 100), (5, 100_000), (40, 100_000), (3, 2_000_000)])
def test_a_dictionary_whatever_the_size(count, size):
    rng = random.Random(count)
    words = [f"word{k}" for k in range(500)]
    pages = [" ".join(rng.choice(words) for _ in range(size // 8 + 1)).encode() for _ in range(count)]
    records = [warc.record_bytes(k, "u", p, len(p), hashlib.sha256(p).hexdigest(), None) for k, p in enumerate(pages)]
    content = warc.archive_bytes(records)
    assert content[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(content[4:8], "little") >= 8
    assert list(warc.frames(content)) == records


def test_many_copies_of_a_page(spark):
    df = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.rpad(F.lit("x"), 2000, "y").alias("html"))
    got = warc.read_archives(warc.write_archives(df), with_payload=False)
    assert got.groupBy("record_type", "refers_to").count().orderBy("count").collect() == [("response", None, 1), ("revisit", 0, 19_999)]


def test_a_compressed_dictionary_is_read(spark):
    records = [warc.record_bytes(k, "u", b"abc" * k, 3 * k, hashlib.sha256(b"abc" * k).hexdigest(), None) for k in range(60)]
    content = warc.archive_bytes(records)
    size = int.from_bytes(content[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    assert list(warc.frames(content[:4] + len(packed).to_bytes(4, "little") + packed + content[8 + size :])) == records


def test_damage_is_reported(spark):
    records = [warc.record_bytes(k, "u", b"abc" * 50, 150, hashlib.sha256(b"abc" * 50).hexdigest(), None) for k in range(3)]
    good = warc.archive_bytes(records)
    bad_length = records[0].replace(b"Content-Length: 150", b"Content-Length: 151")
    cases = [good[:-3], good + b"abc", good + b"abcdefgh" * 2, warc.archive_bytes([records[0][:-1]]), warc.archive_bytes([bad_length]), warc.archive_bytes([b"HTTP/1.1 200 OK\r\n\r\n"]), warc.archive_bytes([records[0].replace(b"WARC-Type", b"WARC-Tipe")]), b"", None]
    got = warc.read_archives(spark.createDataFrame([(c,) for c in cases], "content binary")).collect()
    assert sum(r.error is not None for r in got) == 7 and sum(r.error is None for r in got) == 2 + 3 + 3


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, n):
    assert warc.read_archives(warc.write_archives(pages(spark).limit(n))).count() == 0


def test_a_frame_that_hides_its_size_is_read_up_to_the_limit(spark, monkeypatch, tmp_path):
    writer = zstandard.ZstdCompressor(level=3, write_content_size=False).compressobj()
    bomb = writer.compress(bytes(50 << 20)) + writer.flush()
    monkeypatch.setattr(warc, "MOST_BYTES", 4 << 20)
    peak = []
    monkeypatch.setattr(warc, "PIECE_BYTES", 1 << 20)
    with pytest.raises(warc.WarcError, match="too large"):
        for record in warc.frames(bomb):
            peak.append(len(record))
    assert not peak
    honest = warc.record_bytes(1, "u", b"body" * 100, 400, "d" * 64, None)
    assert list(warc.frames(warc.archive_bytes([honest]))) == [honest]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.zst").write_bytes(bytes(3 << 20))
    assert warc.archive_files(spark, f"{tmp_path}/a").count() == 1
    monkeypatch.setattr(warc, "MOST_BYTES", 3 << 20)
    with pytest.raises(warc.WarcError, match="x.warc.zst"):
        warc.archive_files(spark, f"{tmp_path}/a")
