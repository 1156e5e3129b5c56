"""Small documents with the cases that every operator must stand: nulls, ties, repeats, long texts."""

import random
import re

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
#: Columns beyond those of documents have names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, gone string, found_places double"


def documents(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The documents of the smallest input, edge cases, and columns with clashing names."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    body = [word() for _ in range(400)]
    for k, text in enumerate([None, "", "   \n\t ", "one", "one two three four", " ".join(body), " ".join(body), " ".join(body[:370] + ["changed"] * 5), " ".join(body[100:180] + [word() for _ in range(100)]), " ".join(body[130:] + body[:60]), "\n".join(" ".join(body[i : i + 8]) for i in range(0, 400, 8)), " ".join(word() for _ in range(30_000))]):
        rows.append((9000 + k, text, "en", None, None))
    rows += [(9005, " ".join(body), "en", "again", 1), (None, " ".join(body), None, None, None), (None, None, None, None, None)]
    rows += [(*r, *([None] * (5 - len(r)))) for r in extra]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "x", k, "y", 0.5) for k, r in enumerate(rows)], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def same_rows(a, b) -> None:
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(map(tuple, a), key=key), sorted(map(tuple, b), key=key)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if x != y][:3] == []
