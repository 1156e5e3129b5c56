"""The registered queries over whole tables: DuckDB's rows where SQL can express them, else a plain version or held-out accuracy."""

import hashlib
import zlib

import duckdb
import pytest

from labelmill.llm import linededup
from labelmill.llm.queries import QUERIES, SQL
from tests.llm.common import SMALL, same_rows
from tests.llm.test_linededup import brute as plain_lines
from tests.llm.test_packing import check
from tests.test_queries import TABLES, plain

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def texts(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def auc(rows):
    """Share of pairs of a toxic and an ordinary row (score, label) in the right order; ties count half."""
    ranked, below, won = sorted(rows), 0.0, 0.0
    for score in sorted({s for s, _ in ranked}):
        labels = [y for s, y in ranked if s == score]
        won += sum(labels) * (below + (len(labels) - sum(labels)) / 2)
        below += len(labels) - sum(labels)
    return won / (below * (len(ranked) - below))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_packing_query(spark):
    used, least = check(QUERIES["op1_best_fit_packing"](spark, SMALL).collect(), texts(spark), 4096)
    assert used <= least + 1


def test_media_query(spark):
    got, want = QUERIES["op4_media_columns"](spark, SMALL), []
    for r in texts(spark):
        data = (r.text or "").encode()
        stored = data + bytes(-len(data) % 64 if data else 64)
        want.append((r.doc_id, len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:])))
    same_rows(got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect(), want)
    assert got.groupBy("payload_sha256").agg({"media_sha256": "approx_count_distinct", "feature": "approx_count_distinct"}).toDF("payload", "media", "feature").where("media > 1 OR feature > 1").count() == 0
    assert got.where("media_bytes <= payload_bytes OR feature IS NULL").count() == 0


def test_language_query(spark):
    got = QUERIES["op6_language_id"](spark, LARGER).collect()
    lang = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang").collect()}
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in lang[r.doc_id].text or "")) for r in got)
    held = [r.lang_pred == lang[r.doc_id].lang for r in got if r.held_out and lang[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert len(held) > 150 and sum(held) >= 0.98 * len(held)


def test_line_query(spark):
    rows = [tuple(r) for r in texts(spark, LARGER)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    kept = [(r.k, r.text) for r in linededup.dedup_lines(docs, drop_emptied=False).collect()]
    assert dict(kept) == {k: t for k, (_, t, _) in enumerate(plain_lines(rows))}
    got = QUERIES["op7_line_dedup"](spark, LARGER).select("doc_id", "kept_sha256").collect()
    same_rows(got, [(rows[k][0], hashlib.sha256((t or "").encode()).hexdigest()) for k, t in kept])


def test_toxicity_query(spark):
    got = QUERIES["op10_toxicity"](spark, LARGER).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in texts(spark, LARGER))
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").where("toxic IN (0, 1)").collect()}
    held = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert sum(y for _, y in held) >= 3 and auc(held) >= 0.85
