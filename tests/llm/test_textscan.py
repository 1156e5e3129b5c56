"""Word and window hashes: distinct where texts differ, equal where they don't, and bounded memory."""

import random
import resource

import numpy as np
import pyarrow as pa

from labelmill.llm import substrings
from labelmill.llm import textscan as ts


def scan(*texts):
    ((_, one),) = ts.scans(pa.array(texts), ts.NOT_SPACE, ts.IDENTITY, limit=1 << 40)
    return one


def thue_morse(n):
    body = b"a"
    while len(body) < n:
        body += bytes(ord("a") + ord("b") - c for c in body)
    return body


def test_words_of_a_regular_structure_differ():
    for n in (512, 1024, 2048, 4096, 8192):
        one = thue_morse(n)
        other = bytes(ord("a") + ord("b") - c for c in one)
        got = scan(f"{one.decode()} {other.decode()}")
        assert got.words[0] != got.words[1] and got.second[0] != got.second[1]


def test_hashes_depend_on_the_words_alone():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé\U0001f642") for _ in range(rng.choice((1, 3, 7, 8, 9, 16, 17, 40, 5000)))) for _ in range(300)]
    alone = {w: (scan(w).words[0], scan(w).second[0]) for w in words}
    assert len({a for a, _ in alone.values()}) == len({b for _, b in alone.values()}) == len(alone)
    got = scan(*(" ".join(words[k : k + 30]) for k in range(0, 300, 30)))
    assert [(a, b) for a, b in zip(got.words, got.second)] == [alone[w] for w in words]


def test_windows_of_every_size():
    rng = random.Random(2)
    words = [rng.choice("abc") for _ in range(200)]
    one = scan(" ".join(words))
    for size in (1, 2, 3, 5, 7, 8, 10, 25, 50, 64):
        hashes = ts.gram_hashes(one.words, size)
        meaning = {}
        for k, h in enumerate(hashes.tolist()):
            meaning.setdefault(h, set()).add(tuple(words[k : k + size]))
        assert all(len(x) == 1 for x in meaning.values())
        assert len(meaning) == len({tuple(words[k : k + size]) for k in range(len(hashes))})
    ts.CHUNK, usual = 16, ts.CHUNK
    assert (ts.gram_hashes(one.words, 25) == scan(" ".join(words)).grams(25)).all() and len(substrings.anchors(one, 50)[0])
    few = substrings.anchors(one, 50)
    ts.CHUNK = usual
    assert all((a == b).all() for a, b in zip(few, substrings.anchors(one, 50)))


def test_a_long_text_takes_little_memory():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    column = pa.array([" ".join(rng.choice(words) for _ in range(50_000)) * 120])
    size = column.nbytes
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _, one in ts.scans(column, ts.NOT_SPACE, ts.IDENTITY):
        substrings.anchors(one, 50)
        one.windows(5, 5)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 10 * size


def test_kept_words():
    one = scan("x y  z", "", "a", " b c ")
    assert substrings.kept_words(one, np.array([True, False, True, False, False, True])) == [b"x z", b"", b"", b"c"]
    assert substrings.kept_words(one, np.ones(6, bool)) == [b"x y z", b"", b"a", b"b c"]
    assert substrings.kept_words(one, np.zeros(6, bool)) == [b"", b"", b"", b""]
