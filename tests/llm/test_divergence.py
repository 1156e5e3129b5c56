"""Source divergence against plain loops over every term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from labelmill.llm import divergence
from tests.llm.common import documents, empty, lower, same_rows

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least_docs=10, top=10):
    """rows: (text, lang, source). Every kept term of every pair of sources, one by one."""
    groups, held, docs = set(), defaultdict(Counter), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        held[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (own, t), n in docs.items() if own == lang and n >= least_docs]
        sources = sorted(s for own, s in groups if own == lang)
        n = {s: {t: held[lang, s][t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n[s][t] + 2) // (sum(n[s].values()) + 2 * len(kept)) for t in kept} for s in n}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for s in sources:
            pairs = sorted((-sum(f(s, o, t) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(s, None, t), t.encode()) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t])[:top]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(items, 1)]
    return out


def test_documents(spark):
    docs = documents(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    got = divergence.source_divergence(docs)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    same_rows(got.select(COLUMNS).collect(), brute(rows))


def test_ties_groups_without_terms_and_wide_sources(spark):
    rng = random.Random(3)
    words = ["a", "b", "É", "é", "中文", "zz", "c" * 300]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["x", None]), f"s{rng.randint(0, 40)}") for _ in range(300)]
    rows += [("12 34", "x", "none"), (None, "x", None), ("alone", "one", "only"), ("a", "two", "p"), (None, "two", "q"), (None, None, None)]
    docs = spark.createDataFrame([(k % 7, *r, "c") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, cells string")
    same_rows(divergence.source_divergence(docs, least_docs=3, top=2).collect(), brute(rows, 3, 2))


def test_tallies_of_a_task_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "HELD_PAIRS", 20)
    monkeypatch.setattr(divergence, "PIECE", 7)
    rng = random.Random(4)
    rows = [(" ".join(rng.choices("abcdefgh", k=30)), "x", f"s{rng.randint(0, 9)}") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    same_rows(divergence.source_divergence(docs, least_docs=1).collect(), brute(rows, 1))


def test_counts_beyond_longs(spark):
    row = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 5)], "n long, total long, size long")
    assert row.select(divergence.probability(row["n"], row["total"], row["size"]).alias("p")).first().p == 1 + 10**9 * (9 * 10**18 + 2) // (9 * 10**18 + 10)


def test_empty(spark):
    assert divergence.source_divergence(empty(spark)).collect() == []


@pytest.mark.parametrize("text", ["", "a", "a" * 50, "aa " * 20, "é" * 9 + " x"])
def test_pieces_hold_whole_terms(monkeypatch, text):
    monkeypatch.setattr(divergence, "PIECE", 5)
    pieces = list(divergence._pieces(text.encode()))
    assert b"".join(pieces) == text.encode()
    assert [t for p in pieces for t in divergence._TERM.findall(p)] == divergence._TERM.findall(text.encode())
