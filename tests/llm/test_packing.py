import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from labelmill.llm import packing
from tests.llm.common import documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(tokenizer, text):
    return array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]).tobytes()


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(d.doc_id), k // 4 // capacity, k // 4, len(part) // 4, zlib.crc32(part)) for d in docs for ids in [plain(tokenizer, d.text)] for k in range(0, len(ids), 4 * capacity) for part in [ids[k : k + 4 * capacity]])
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_whole_documents_in_few_sequences(spark):
    docs = documents(spark)
    used, least = check(packing.pack(docs, PATH).collect(), docs.collect(), 4096)
    assert used <= least + 1


def test_many_shards_cost_next_to_nothing(spark):
    docs = documents(spark)
    used, least = check(packing.pack(docs, PATH, capacity=512, shard_pieces=40).collect(), docs.collect(), 512)
    assert used <= 1.02 * least + 1


def test_encoder_equals_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH, words=50)
    texts = ["it's DON'T, we'll x's. ''s", "Ünïcode ÉÀ ßtraße, naïve÷x é ≮ ,̸", "a b c\x85d\x1ce", "1234 12a a12, a.b,c ,,.. #$%*&", "<|endoftext|> <|ENDOFTEXT|>", "K K İ ﬁ ǅ", "日本語 текст العربية 🙂🙂", "", " \t\n", "word" * 500]
    for text in texts:
        assert encoder.encode(text.encode()) == plain(tokenizer, text)[:-4], text


def test_other_tokenizers_read_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    assert not encoder.by_words and packing.WordEncoder(PATH).by_words
    for text in ["It's  two\n\n  spaces", "UPPER lower", "a\tb \u2009c", "", " x", "<|endoftext|> y"]:
        assert encoder.encode(text.encode()) == plain(tokenizer, text)[:-4], text
    docs = documents(spark)
    rows = packing.pack(docs, path).collect()
    want = sorted((str(d.doc_id), k // 4 // 4096, zlib.crc32(ids[k : k + 4 * 4096])) for d in docs.collect() for ids in [plain(tokenizer, d.text)] for k in range(0, len(ids), 4 * 4096))
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in rows) == want


def test_local_search_empties_a_sequence():
    lengths = np.array([6, 5, 5, 4])
    bins = packing.improve([[0], [1], [2, 3]], lengths, 10)
    assert sorted(sorted(lengths[b].tolist()) for b in bins) == [[4, 6], [5, 5]]
    two_for_one = np.array([5, 3, 2, 6, 4])
    bins = packing.improve([[1, 2], [3], [0], [4]], two_for_one, 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(5))


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


def test_slices_of_a_long_text_give_the_same_ids(monkeypatch):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = ("Some words,\tand  more words.\nÉté 漢字 <|endoftext|> x<|EndOfText|>y <|endoftext|><| " * 50).encode()
    whole = array("I", encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()
    assert encoder.encode(text) == whole
    for size in (1, 2, 5, 64, 1000):
        monkeypatch.setattr(packing, "SLICE_BYTES", size)
        assert encoder.encode(text) == whole
