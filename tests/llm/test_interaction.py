"""Filter interactions against filters that are really applied, one after another, in every order."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from labelmill.llm import interaction
from tests.llm.common import documents, empty, same_rows, space_words

LABELS = "doc_id long, quality int, toxic int, part string, mask int"


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in rows:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    parts = defaultdict(list)
    for d, text, source in rows:
        t = text or ""
        words = space_words(t)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        fails += "D" * bool(re.search("[#$%&*|]", t))
        fails += "E" * (d is not None and d > first[t])
        parts[source or ""].append((d, fails))
    out = []
    for part, docs in parts.items():
        steps, removed_by = [], defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                removed_by[letter] += len(gone)
                failing = sum(letter in f for _, f in docs)
                steps.append((part, order, step, len(left), len(gone), failing - len(gone), sum(f == letter for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return out


def test_documents(spark):
    long = " ".join(f"w{k}" for k in range(300))
    extra = [(7000 + k, t, None, s) for k, (t, s) in enumerate([(long, "a"), (long, None), (long, "a"), (long.upper(), "a"), ("x " * 300, "a"), (long + " #", "b"), ("É" * 60 + "AB", "b"), (None, "b"), ("", "b")])]
    docs = documents(spark, extra + [(7001, long, None, "b")])
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    labels = [(d, k % 2, int(k % 3 == 0), "x", 1) for k, d in enumerate(ids) if k % 4] + [(7000, 1, 0, "x", 2), (7000, 0, 1, "x", 2), (7001, None, None, None, None), (None, 1, 1, None, None)]
    got = interaction.filter_interactions(docs, spark.createDataFrame(labels, LABELS))
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    same_rows(got.collect(), brute([(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()], [r[:3] for r in labels]))


def test_survivors_are_those_that_fail_none_of_a_set():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (32, 3))
    left = interaction.survivors(counts)
    for s in range(32):
        assert (left[s] == sum(counts[m] for m in range(32) if not m & s)).all()


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = (" ".join(f"word{k % 120}" for k in range(230)) + "\t\n" + "y" * 50).encode()
    whole = interaction.text_mask(text)
    for size in (1, 3, 10, 64):
        monkeypatch.setattr(interaction, "PIECE", size)
        assert interaction.text_mask(text) == whole


def test_edges_of_the_filters():
    assert interaction.text_mask(b"") == 1
    assert interaction.text_mask(" ".join(f"w{k}" for k in range(200)).encode()) == 0
    assert interaction.text_mask(" ".join(f"w{k % 100}" for k in range(200)).encode()) == 0
    assert interaction.text_mask(" ".join(f"w{k % 99}" for k in range(200)).encode()) == 2
    assert interaction.text_mask(("é" * 98 + "AB").encode()) == 1
    assert interaction.text_mask(("é" * 97 + "AB").encode()) == 5


def test_empty(spark):
    labels = spark.createDataFrame([(1, 1, 1, None, None)], LABELS)
    assert interaction.filter_interactions(empty(spark), labels).collect() == []
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert interaction.filter_interactions(docs, labels.limit(0)).where("good_lost + toxic_lost > 0 OR kept + removed > 1").count() == 0
