"""Line dedup against a plain version that shares no code with the operator."""

import random
import re

import xxhash

from labelmill.llm import linededup
from labelmill.llm.linededup import patience
from tests.llm.common import documents, empty, same_rows


def is_long(line):
    return len(re.findall(r"[^ \t\x0b\f\r]+", line)) >= 5 or sum(len(c.encode()) for c in line if ord(c) >= 0x80) >= 30


def seeds_of(lines):
    """(first, end, words) of each seed of a list of lines that aren't empty."""
    for i, x in enumerate(lines):
        if is_long(x):
            yield i, i + 1, (x,)
    for i in range(len(lines) - 2):
        run = tuple(lines[i : i + 3])
        if not all(map(is_long, run)):
            yield i, i + 3, run


def full_lines(text):
    return [x for x in text.split("\n") if x]


def plain_rising(points):
    """Longest part with ascending second places: by length so far, of equals the latest."""
    length = [1] * len(points)
    for k, (_, y) in enumerate(points):
        length[k] = 1 + max((length[m] for m in range(k) if points[m][1] < y), default=0)
    chain, want, at = [], max(length, default=0), len(points)
    while want:
        at = max(m for m in range(at) if length[m] == want)
        chain.append(points[at])
        want -= 1
    return chain[::-1]


def plain_lcs(a, b):
    """By the full table, from the end: drop of the first text where that costs nothing, else of the second, else a pair."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    i, j, pairs = len(a), len(b), []
    while i and j:
        if best[i - 1][j] == best[i][j]:
            i -= 1
        elif best[i][j - 1] == best[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs


def plain_patience(a, b):
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    fixed = plain_rising([(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == b.count(x) == 1])
    if not fixed:
        return plain_lcs(a, b)
    out, i0, j0 = list(fixed), 0, 0
    for i, j in [*fixed, (len(a), len(b))]:
        out += [(x + i0, y + j0) for x, y in plain_patience(a[i0:i], b[j0:j])]
        i0, j0 = i + 1, j + 1
    return out


def plain_runs(a, b):
    """Pairs of what one alignment leaves of b: each item at its next place in a, from the front again where there is none."""
    out, last = [], -1
    for j, x in b:
        behind = [i for i, y in enumerate(a) if y == x and i > last] or [i for i, y in enumerate(a) if y == x]
        last = behind[0]
        out.append((last, j))
    return out


def signed_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >> 63 else h


def brute(rows):
    """(doc_id, text, hit) of each row without the blocks that are aligned with an owner of their seeds."""
    held = {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None and t is not None}):
        for first, end, run in seeds_of(full_lines(t)):
            held.setdefault(run, []).append((d, t, first, end))
    out = []
    for d, t in rows:
        gone, lines = set(), full_lines(t) if d is not None and t is not None else []
        mine = sorted((first, end, run) for first, end, run in seeds_of(lines) if held[run][0][0] < d)
        for owner in {held[run][0][0] for _, _, run in mine}:
            late = [x for x in mine if held[x[2]][0][0] == owner]
            asked, early = [x[2] for x in late], []
            for run in set(asked):
                # Of several texts under one doc_id that of the smallest hash owns it.
                text = min((h[1] for h in held[run] if h[0] == owner), key=signed_hash)
                own = [h for h in held[run] if h[:2] == (owner, text)]
                early += sorted((first, end, run, h) for *h, first, end in own)[: asked.count(run)]
            early.sort(key=lambda x: x[:2])
            theirs = [x[2] for x in early]
            pairs = plain_patience(theirs, asked)
            left = [(j, x) for j, x in enumerate(asked) if j not in {j for _, j in pairs}]
            for i, j in pairs + plain_runs(theirs, left):
                (first, end, _), (a, b, _, (_, text)) = late[j], early[i]
                other = full_lines(text)
                gone |= set(range(first, end))
                gone |= {first - 1} if first and a and other[a - 1] == lines[first - 1] else set()
                gone |= {end} if end < len(lines) and b < len(other) and other[b] == lines[end] else set()
        out.append((d, without(t, gone) if gone else t, bool(gone)))
    return out


def without(text, gone):
    kept, k = [], 0
    for line in text.split("\n"):
        if line:
            k += 1
            if k - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept)


def cut(spark, rows, **how):
    """(place in rows, text afterwards)."""
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, k int")
    return [(r.k, r.text) for r in linededup.dedup_lines(docs, drop_emptied=False, **how).collect()]


def test_patience_finds_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert patience(list("abcd"), list("abcd")) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert patience(list("xaybz"), list("qaxbw")) == [(1, 1), (3, 3)]


def test_documents(spark):
    block = "one two three four five six\nmid\nseven eight nine ten eleven twelve"
    extra = [(7001, f"head line that is only here at all\n{block}\nend", None), (7002, f"{block}\nand a tail that nobody else has", None), (7003, block, None), (7004, "mid\nmid\nmid", None), (7005, f"x\r\n{block}\r\n", None), (7006, f"{block}\n{block}", None), (7006, "again another text here under this id", None), (7007, "\n\n".join("abc"), None), (7008, "z\na\n\nb\nc\n", None)]
    docs = documents(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = linededup.dedup_lines(docs, drop_emptied=False)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    same_rows([(r.doc_id, r.text) for r in got.collect()], [(d, t) for d, t, _ in want])
    kept = linededup.dedup_lines(docs)
    assert kept.where("doc_id = 7001").first().text.endswith("end") and kept.where("doc_id = 7003").count() == 0
    assert kept.where("doc_id = 7002").first().text == "and a tail that nobody else has"
    assert kept.where("doc_id = 7008").first().text == "z\n\n"
    unchanged = {(d, t) for d, t, hit in want if not hit}
    assert all(r.n_chars is None or (r.doc_id, r.text) in unchanged or r.n_chars == len(r.text) for r in kept.collect())


def test_aligned_lines_beside_a_seed_go(spark):
    rows = [(1, "a b c d e\nshort\ntail\nother"), (2, "new\na b c d e\nshort\ngap\ntail"), (3, "before\nk l m n o\nv w x y z"), (4, "before\nk l m n o\nq"), (5, "before\nk l m n o\nq")]
    assert dict(cut(spark, rows)) == {0: rows[0][1], 1: "new\ngap\ntail", 2: rows[2][1], 3: "q", 4: ""}


def test_short_lines_in_a_row_are_found(spark):
    verse = "\n".join(["so", "la", "ti"])
    rows = [(1, f"mine\n{verse}"), (2, f"x\n{verse}\ny"), (3, "so\nla\nother"), (4, "漢字仮名交文章例示本文"), (5, "甲\n漢字仮名交文章例示本文\n乙")]
    assert dict(cut(spark, rows)) == {0: rows[0][1], 1: "x\ny", 2: rows[2][1], 3: rows[3][1], 4: "甲\n乙"}


def test_no_seed_stays_later(spark):
    rng = random.Random(9)
    S = [f"seed line number {w} of this text" for w in ("one", "two", "three", "four")]
    # Repeated in the later document, in its owner, in both, and in another order.
    rows = [(1, "\n".join([S[0], "x", S[1], S[0], S[2]])), (2, "\n".join(["own", S[2], S[1], S[0], "x", "mine", S[0], S[0], "end"])), (3, "\n".join([S[3], *S[:3][::-1], S[3]])), (4, "\n".join(["p", S[3], "q", S[3], S[0], "x", S[1], "r"]))]
    pool = [*S, "x", "y", "short z", "t", "u", ""]
    rows += [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for d in range(5, 80)]
    # Repeated rows, as the earliest holder and as later ones; several texts under one id; no id.
    rows += [rows[0], rows[0], rows[1], (3, "\n".join(S)), (None, "\n".join(S)), (200, None), (201, "")]
    assert dict(cut(spark, rows)) == {k: t for k, (_, t, _) in enumerate(brute(rows))}


def test_nothing_goes_that_is_not_aligned(spark, monkeypatch):
    block = "\n".join(f"this is line number {k} of a block" for k in range(6))
    rows = [(1, block), (2, f"new\n{block}"), (3, block + "\n" + block)]
    assert dict(cut(spark, rows)) == {0: block, 1: "new", 2: ""}
    monkeypatch.setattr(linededup, "patience", lambda a, b: [])
    assert dict(cut(spark, rows)) == {0: block, 1: rows[1][1], 2: rows[2][1]}


def test_moved_and_repeated_blocks_go(spark):
    line = lambda k: f"this is line number {k} of a text"
    one, two, three = ("\n".join(map(line, r)) for r in (range(4), range(4, 7), range(7, 12)))
    rows = [(1, f"{one}\nplain\n{two}\n{three}"), (2, f"{three}\nmine\n{one}\n{two}\n{one}\nend"), (3, "\n".join(map(line, range(11, -1, -1)))), (4, (line(3) + "\n") * 5000 + "rest")]
    assert dict(cut(spark, rows)) == {0: rows[0][1], 1: "mine\nend", 2: "", 3: "rest"}


def test_runs_of_what_one_alignment_leaves():
    rng = random.Random(6)
    for _ in range(500):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 9))]
        b = [rng.choice(a) for _ in range(rng.randint(0, 9))]
        got = [(i, j) for run in linededup.ascending_runs(a, b) for i, j in zip(*run)]
        assert got == plain_runs(a, list(enumerate(b))) and all(a[i] == b[j] for i, j in got)
        assert all(p < q for at, _ in linededup.ascending_runs(a, b) for p, q in zip(at, at[1:]))


def test_patience_breaks_ties_as_stated():
    rng = random.Random(7)
    for _ in range(1500):
        a, b = ([rng.choice("abcdefghijkl"[: rng.randint(1, 12)]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert sorted(patience(a, b)) == sorted(plain_patience(a, b))


def test_one_document_with_lines_of_very_many_owners(spark):
    """Each pair carries its own lines only, so rows grow with lines and not with lines times owners."""
    n = 20_000
    line = lambda k: f"line that only document number {k} had before"
    rows = [(k, f"{line(k)}\nown {k}") for k in range(n)] + [(n, "\n".join(map(line, range(n))) + "\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linededup.dedup_lines(docs).where(f"doc_id = {n}").first().text == "end"


def test_many_copies_of_one_document(spark):
    text = "\n".join(f"this is line number {k} of many" if k % 3 else f"short {k}" for k in range(30))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"'{text}' AS text".replace("\n", "\\n"))
    assert [r.doc_id for r in linededup.dedup_lines(docs).collect()] == [0]


def test_empty_table(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_ordinary_diff_where_no_line_is_unique():
    rng = random.Random(2)
    assert len(patience(list("aabbcc"), list("abc"))) == 3
    for bits in (linededup.LCS_BITS, 8):
        linededup.LCS_BITS, usual = bits, linededup.LCS_BITS
        for _ in range(500):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            pairs = linededup._lcs(a, b)
            assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        linededup.LCS_BITS = usual
