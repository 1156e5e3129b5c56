"""Stages on a small input: each against what its operator's plain version says, and run() as a whole."""

import corpus_pipeline
import public_tokenizers
from tests.llm.common import SMALL
from tests.llm.test_linededup import brute as plain_lines
from tests.llm.test_neardedup import brute as plain_near
from tests.llm.test_packing import check
from tests.llm.test_rowwise import contaminated


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, SMALL)
        assert out.columns == columns
        path = f"{corpus_pipeline.materialize(out, 'test').inputFiles()[0].rpartition('/')[0]}"
        return spark.read.parquet(path)

    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    first = step("language_id", docs)
    assert 0.99 * docs.count() <= first.count() <= docs.count()
    second = step("line_dedup", first)
    cut = [(d, t) for d, t, hit in plain_lines(rows(first)) if t.strip() or not hit]
    assert sorted(rows(second)) == sorted(cut)
    third = step("near_dedup", second)
    want = plain_near(rows(second))
    assert sorted(rows(third)) == sorted((d, t) for d, t in rows(second) if want[d][1] == d)
    fourth = step("decontamination", third)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert sorted(rows(fourth)) == sorted((d, t) for d, t in rows(third) if not contaminated([(d, t)], items)[0][5])
    packed = stages["packing"](spark, fourth, SMALL).collect()
    used, least = check(packed, fourth.collect(), 4096)
    assert used <= least + 1
    assert public_tokenizers.path("word_bpe_49k.json") == corpus_pipeline.WORD_TOKENIZER
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(key, packed))
