"""Decontamination, media columns, language, toxicity and chat: against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from labelmill.llm import chat, decontam, langid, media, toxicity
from tests.llm.common import SMALL, documents, empty, lower, same_rows


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def benchmark(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    return spark.createDataFrame([*rows, (500, "Two Words"), (501, "Two Words"), (502, None), (503, " .,; "), (None, "one two three four"), (504, "one")], "item_id long, text string")


def contaminated(docs, items):
    windows = {}
    for item_id, text in items:
        words = alnum(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[i : i + 10]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, found = alnum(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (ids := windows.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [decontam.INDEX_BYTES, 0])
def test_contamination(spark, limit):
    extra = [(8000, "Before. two  WORDS, after; two-words", None), (8001, "ONE TWO three.four five", None)]
    docs, items = documents(spark, extra), benchmark(spark)
    got = decontam.contamination(docs, items, limit=limit).collect()
    same_rows(got, contaminated([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()]))


@pytest.mark.parametrize("limit", [decontam.INDEX_BYTES, 0])
def test_removal_keeps_the_rest(spark, limit):
    docs, items = documents(spark, [(8000, "Before. two  WORDS, after; two-words", None)]), benchmark(spark)
    hit = {(r[0], r[1]) for r in [(d.doc_id, d.text) for d in docs.collect()] if contaminated([r], [tuple(x) for x in items.collect()])[0][5]}
    kept = decontam.decontaminate(docs, items, limit=limit)
    assert kept.columns == docs.columns
    same_rows(kept.collect(), [r for r in docs.collect() if (r.doc_id, r.text) not in hit])
    cut = decontam.decontaminate(docs, items, "spans", limit=limit)
    assert cut.count() == docs.count() and cut.where("doc_id = 8000").first().text == "Before. , after; "
    same_rows([r for r in cut.collect() if (r.doc_id, r.text) in {(d.doc_id, d.text) for d in docs.collect()} - hit], [r for r in docs.collect() if (r.doc_id, r.text) not in hit])


def test_empty_tables(spark):
    none = empty(spark)
    assert decontam.contamination(none, benchmark(spark)).count() == 0
    docs = documents(spark)
    assert decontam.contamination(docs, benchmark(spark).limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs, benchmark(spark).limit(0), limit=-1).count() == docs.count()
    assert media.media_features(media.media_column(none)).count() == 0
    assert langid.identify(none, langid.fit_on(none)).count() == 0
    assert toxicity.toxicity(none, toxicity.fit([])).count() == 0
    assert chat.conversation_digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_media_round_trip(spark):
    docs = documents(spark)
    got = media.media_features(media.media_column(docs))
    assert got.where("error IS NOT NULL").count() == 0
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        stored = data + bytes(-len(data) % 64 if data else 64)
        want.append((r.doc_id, len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:])))
    same_rows([tuple(r)[:5] for r in got.collect()], want)
    assert got.select("payload_sha256").distinct().count() == got.select("media_sha256").distinct().count()


def test_media_tables_and_damage():
    payload = bytes(range(256)) * 300
    data = media.mux(payload)
    track = media.probe(data)
    assert track.codec == "raw" and track.duration == len(payload) and track.stored(data) == payload
    assert [bytes(data[a:b]) for a, b in track.key_ranges()] == [payload[k : k + 64] for k in range(0, len(payload), 64 * 16)]
    for broken in (data[:40], data[: len(data) // 2], data.replace(b"stsz", b"stsx"), b"\0\0\0\3free", b""):
        with pytest.raises(media.MediaError):
            media.probe(broken)


def test_media_odd_sample_tables():
    """Chunks out of order and samples of their own sizes, as other writers make them."""
    import struct

    payload, sizes, chunks = b"AAAABBCCCCCC", [4, 2, 6], [[2], [0, 1]]
    head = media.box(b"ftyp", b"isom", bytes(4))
    body = b"".join(payload[sum(sizes[:i]) : sum(sizes[: i + 1])] for c in chunks for i in c)

    def moov(first):
        table = media.box(b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(28))), media.full_box(b"stts", struct.pack(">IIIII", 2, 1, 10, 2, 5)), media.full_box(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full_box(b"stsz", struct.pack(">II3I", 0, 3, *sizes)), media.full_box(b"co64", struct.pack(">IQQ", 2, first + 6, first)))
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIIII", 0, 0, 10, 20, 0)), media.box(b"minf", table))))

    index = moov(0)
    data = head + moov(len(head) + len(index) + 8) + media.box(b"mdat", body)
    track = media.probe(data)
    assert track.codec == "mp4a" and track.stored(data) == payload and track.durations.tolist() == [10, 5, 5] and len(track.keys) == 3


def test_language(spark):
    docs = documents(spark, [(7000, "123 !!", None), (7001, "日本語の文章", None)])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit_on(docs.where(~held & (F.col("doc_id") < 1000)))
    got = langid.identify(docs, model, held)
    rows = got.where("doc_id < 1000 AND held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 20
    assert got.where("lang_pred = 'und'").count() == got.where("score = 0 AND rejected").count() == 5
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1").count() == 0
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id < 1000").count() >= 0.99 * docs.where("doc_id < 1000").count()
    assert kept.where("doc_id = 7000 OR text IS NULL").count() == 0


def test_ngrams_stay_in_their_text():
    one = [langid.ngram_counts(*parts(t)) for t in ("Ab1c", "", "née")]
    both = langid.ngram_counts(*parts("Ab1c", "", "née"))
    assert (np.concatenate(one) == both).all() and both[1].sum() == 0 and both[0].sum() == 3 + 2 + 2 + 1


def parts(*texts):
    return langid.ts.binary_parts(pa.array(texts))


def test_toxicity(spark):
    rng = random.Random(1)
    bad = ["stupid", "idiot", "worthless", "scum"]
    syllables = ["er", "th", "an", "on", "re", "st", "ly", "in"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.randint(30, 200))]
        if k % 5 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([r for r in labels if r[0] % 3] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit_on(docs, known)).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    rest = [(r.predicted, int(r.doc_id % 5 == 0)) for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 3 == 0]
    assert sum(p == y for p, y in rest) >= 0.95 * len(rest)
    one_class = toxicity.fit_on(docs, known.where("toxic = 0"))
    assert {r.predicted for r in toxicity.toxicity(docs, one_class).collect()} == {0}


PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_digests(turns):
    out, groups = [], {}
    for c, t, role, text in turns:
        groups.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    for c, rows in groups.items():
        rows = [(r[3], r[5]) for r in sorted(rows)]
        loss = "".join(text for role, text in rows if role == "assistant")
        formatted, _ = chat.render(rows)
        out.append((c, len(rows), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
    return out


@pytest.mark.parametrize("segment", [chat.SEGMENT_CHARS, 40])
def test_chat(spark, segment):
    said = "\\### Assistant: </turn> ok"
    turns = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said), (-8, 0, "assistant", None), (-8, 0, None, "x"), (-8, None, "assistant", " \n lead 🙂🙂 é\\n<turn>\\"), (-8, 0, "assistant", None), (-9, 0, "a\nb\\<turn>", "<|endoftext|><</turn></turn>"), (None, 1, "user", "a"), (None, 0, "assistant", "b"), (-10, 5, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, segment int, ids string")
    formatted = chat.format_conversations(df, PATH, segment_chars=segment)
    got = chat.conversation_digests(formatted).collect()
    same_rows([tuple(r)[:6] for r in got], plain_digests(turns))


def test_segments_give_the_same_tokens(spark):
    turns = [("user", "a b"), ("assistant", " c\n"), ("user", "🙂"), ("assistant", "d")]
    encoder = chat.load_tokenizer(PATH)
    whole = encoder.encode(chat.render(turns)[0], add_special_tokens=False).ids
    assert whole == [i for t in turns for i in encoder.encode(chat.render([t])[0], add_special_tokens=False).ids]


def test_foreign_and_junk_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(1)
    junk = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 4, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 4, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150)), rng.randbytes(700).hex()]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit_on(docs)
    assert langid.keep_identified(spark.createDataFrame([(k, t) for k, t in enumerate(junk)], "doc_id long, text string"), model).count() == 0
    lettered = docs.where(F.col("text").rlike("\\p{L}"))
    assert langid.keep_identified(docs, model).count() == lettered.count() > 9000


def test_toxicity_fits_on_bounded_bytes(spark):
    rows = [(1, 1, 60), (2, 1, 50), (3, 0, 90), (4, 0, 10), (5, 1, 10)]
    assert toxicity._within(rows, 200) == [1, 3, 4] and toxicity._within(rows, 240) == [1, 2, 3, 4, 5]
    docs = spark.createDataFrame([(k, "disgusting worthless pathetic text " * 5 if k % 2 else "some plain text here " * 5) for k in range(60)], "doc_id long, text string")
    known = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    for most in (1 << 20, 4000):
        model = toxicity.fit_on(docs, known, training_bytes=most)
        got = {r.doc_id % 2: r.score for r in toxicity.toxicity(docs, model).collect()}
        assert got[1] > got[0]
    assert toxicity.windows("A bc, d".encode()) == {b" a", b" bc", b" d"}


def test_window_lengths_and_evidence_are_those_of_the_dictionaries():
    """The lengths that a window is known by are zstd's own, and evidence is the rate in toxic over ordinary rows."""
    import zstandard

    rng = random.Random(3)
    plain = [{f" {rng.choice('abcdefgh')}{rng.choice('ijklmnop')}{rng.choice('qrstuv')}word{k % 40}".encode() for k in range(60)} for _ in range(300)]
    rows = [(found | ({b" idiot", b" moron"} if k % 4 == 0 else set()), int(k % 4 == 0), 1.0) for k, found in enumerate(plain)]
    model = toxicity.fit(rows)
    for window in (b" idiot", b" aiqword3", b" never seen"):
        sizes = []
        for content in (model.ordinary, model.ordinary + model.toxic):
            settings = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = zstandard.ZstdCompressionDict(content + toxicity.AFTER + toxicity.BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(dict_data=held, compression_params=settings)
            sizes.append([len(coder.compress(toxicity.BEFORE + w + toxicity.AFTER)) for w in (window, b"")])
        assert model.lengths(window) == (min(sizes[0][0] - sizes[1][0], 8), min(max(sizes[1][0] - sizes[1][1], 0), 12))
    late = [(found, label) for k, (found, label, _) in enumerate(rows) if k % 3 == 2]
    cells = [[sum(model.lengths(w) == cell for found, label in late if label == side for w in found) for side in (0, 1)] for cell in model.evidence]
    total = [sum(len(found) for found, label in late if label == side) + 1 for side in (0, 1)]
    for (cell, value), (ordinary, toxic) in zip(model.evidence.items(), cells):
        assert abs(value - min(6.0, np.log((toxic + 0.5) / total[1] * total[0] / (ordinary + 0.5)))) < 1e-9
    assert model.score(b"you idiot and moron") > 0.5 > model.score(b"aiqword3 biqword4")


def test_long_texts_are_counted_in_pieces():
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcé, \n1"), 5000))
    body, offs = parts(text)
    whole = langid.ngram_counts(body, offs)
    for piece in (1, 2, 3, 7, 1000, 4999, len(body) - 1):
        assert (langid.ngram_counts(body, offs, piece) == whole).all()
