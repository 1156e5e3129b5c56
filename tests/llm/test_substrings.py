import hashlib
import random

import numpy as np

from labelmill.llm import substrings
from tests.llm.common import documents, empty, same_rows, space_words


def brute(rows, size):
    first = {}
    for doc_id, text in rows:
        words = space_words(text)
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words, gone = space_words(text), set()
        for i in range(len(words) - size + 1):
            if doc_id is not None and first[tuple(words[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_documents(spark):
    docs = documents(spark)
    same_rows(substrings.remove_repeats(docs).collect(), brute([(r.doc_id, r.text) for r in docs.collect()], 50))


def test_dense_repeats_of_few_words(spark):
    """Periodic texts, passages that begin and end anywhere, and ids out of order."""
    rng = random.Random(7)
    passages = [[rng.choice("ab") for _ in range(rng.randint(8, 40))] for _ in range(6)] + [["x"] * 30, ["p", "q"] * 15]
    rows = []
    for k in range(80):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, 30)] + [rng.choice("abcde") for _ in range(rng.randint(0, 4))]
        rows.append((rng.randrange(60), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (6, 10):
        same_rows(substrings.remove_repeats(docs, size).collect(), brute(rows, size))


def test_sliding_min():
    rng = np.random.default_rng(0)
    for n in (5, 26, 27, 100):
        x = rng.integers(0, 50, n).astype(np.uint64)
        for w in (1, 3, 5):
            assert substrings.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(n - w + 1)]


def test_empty_table(spark):
    assert substrings.remove_repeats(empty(spark), with_text=False).count() == 0
