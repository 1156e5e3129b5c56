"""Fitted models: predictions by plain arithmetic, and nothing learned from what must not be looked at."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from labelmill.llm import langid
from labelmill.llm.queries import QUERIES
from tests.llm.common import SMALL, documents, same_rows


def places(text):
    """Counts of hashed n-grams of the letters of a text, one n-gram at a time."""
    data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    data, found = [32, *data, 32], Counter()
    for size in (2, 3):
        for k in range(len(data) - size + 1):
            gram = data[k : k + size]
            # A pair needs a letter, a triple one in its middle.
            if gram[1] != 32 or (size == 2 and gram[0] != 32):
                code = sum(b << 8 * (size - 1 - i) for i, b in enumerate(gram))
                found[(code * 2654435761 + size * 97) % 2**32 >> 20] += 1
    return found


def nearest(text, model):
    """(language, cosine, whether it is too far) of a text by sums over its n-grams."""
    counts = places(text)
    weights = {p: (1 + math.log(c)) * float(model.idf[p]) for p, c in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    cosines = [sum(w * float(centre[p]) for p, w in weights.items()) / norm for centre in model.centroids]
    best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
    octave = min(int(math.log2(sum(counts.values()))), langid.OCTAVES - 1)
    return model.languages[best], cosines[best], cosines[best] < model.least[best][octave]


def test_language_is_that_of_the_nearest_centroid(spark):
    docs = documents(spark, [(7000, "123 !!", None), (7001, "日本語の文章", None), (7002, "Kaikki ihmiset syntyvät vapaina", None), (7003, "x", None)])
    model = langid.fit_on(docs.where("doc_id < 1000"))
    assert len(set(model.languages)) >= 2 and np.allclose((model.centroids**2).sum(axis=1), 1, atol=1e-5)
    got = langid.identify(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) > 90
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        lang, cosine, far = nearest(r.text, model)
        assert (r.lang_pred, r.rejected) == (lang, far) and abs(r.score - min(max(cosine, 0), 1)) < 1e-4


def test_rarer_ngrams_weigh_more():
    counts = np.zeros((4, langid.PLACES), int)
    counts[:, 1], counts[0, 2], counts[2:, 3] = 1, 5, 2
    model = langid.fit(["a", "a", "b", "b"], counts)
    assert np.allclose(model.idf[[1, 2, 3, 4]], [math.log(5 / (1 + n)) + 1 for n in (4, 1, 2, 0)])


def changed(spark, folder, name, of):
    """The input with one table changed."""
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        (of(df) if t == name else df).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def remainder(folds):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def test_held_out_languages_teach_nothing(spark, tmp_path):
    other = changed(spark, tmp_path, "documents", lambda d: d.withColumn("lang", F.when(remainder(4) == 2, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("changed")))
    query = QUERIES["op6_language_id"]
    want = query(spark, SMALL).collect()
    same_rows(query(spark, other).collect(), want)
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in want if r.held_out} == {True}


def test_held_out_labels_teach_nothing(spark, tmp_path):
    other = changed(spark, tmp_path, "labels", lambda d: d.withColumn("toxic", F.when(remainder(5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    query = QUERIES["op10_toxicity"]
    same_rows(query(spark, other).collect(), query(spark, SMALL).collect())


def test_an_id_that_repeats_is_learnt_from_once(spark):
    from labelmill.llm import toxicity

    rng = random.Random(4)
    words = [f"plain{k}" for k in range(200)]
    rows = [(k, " ".join(rng.choices(words, k=40) + (["vile"] if k % 3 == 0 else []))) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    once = toxicity.fit_on(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = spark.createDataFrame(rows + [rows[3]] * 400 + [(5, None), (None, "vile")], "doc_id long, text string")
    taken = []
    fit, toxicity.fit = toxicity.fit, lambda found: taken.append(len(found)) or fit(found)
    try:
        model = toxicity.fit_on(again, labels)
        toxicity.fit_on(again, labels, training_bytes=2000)
    finally:
        toxicity.fit = fit
    assert taken[0] == 120 and taken[1] < 20
    scores = [[m.start() or m.score(t.encode()) for _, t in rows] for m in (once, model)]
    assert np.allclose(scores[0], scores[1], atol=0.2)


def plain_clusters(rows, k):
    """Spherical k-means by loops, from far-apart first rows; small clusters go."""
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    total = unit([sum(c) for c in zip(*rows)])
    centres = [max(rows, key=lambda r: dot(r, total))]
    while len(centres) < min(k, len(rows)):
        centres.append(min(rows, key=lambda r: max(dot(r, c) for c in centres)))
    near = lambda r: max(range(len(centres)), key=lambda c: dot(r, centres[c]))
    for _ in range(20):
        dealt = [[r for r in rows if near(r) == c] for c in range(len(centres))]
        moved = [unit([sum(x) for x in zip(*some)]) if some else c for some, c in zip(dealt, centres)]
        centres, before = moved, centres
        if all(abs(x - y) < 1e-6 for a, b in zip(centres, before) for x, y in zip(a, b)):
            break
    share = [sum(near(r) == c for r in rows) / len(rows) for c in range(len(centres))]
    return [c for c, s in zip(centres, share) if s >= min(langid.SMALL_CLUSTER, max(share))]


def test_clusters_are_those_of_plain_k_means():
    rng = np.random.default_rng(8)
    for trial in range(20):
        middles = rng.random((4, 6)) + 0.1
        x = np.concatenate([m + rng.random((n, 6)) * 0.2 for m, n in zip(middles, (30, 12, 9, 1))]).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        got, want = langid._clusters(x, 4), plain_clusters(x.tolist(), 4)
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)


def test_scores_of_the_whole_query_by_plain_loops(spark):
    """Each text's words, their two lengths and the evidence of their gain, one by one with fresh compressors."""
    from labelmill.llm import toxicity

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(docs, labels.where(remainder(5) != 0))
    settings = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)

    def taken(window, content):
        dictionary = zstandard.ZstdCompressionDict(content + toxicity.AFTER + toxicity.BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress(window))

    least, known = taken(toxicity.BEFORE + toxicity.AFTER, model.ordinary + model.toxic), {}

    def evidence(word):
        if word not in known:
            window = toxicity.BEFORE + word + toxicity.AFTER
            toxic = taken(window, model.ordinary + model.toxic)
            known[word] = model.evidence.get((min(taken(window, model.ordinary) - toxic, 8), min(max(toxic - least, 0), 12)), 0.0)
        return known[word]

    got = {r.doc_id: r.score for r in QUERIES["op10_toxicity"](spark, SMALL).collect()}
    texts = docs.select("doc_id", "text").limit(60).collect()
    for r in texts:
        words = toxicity.windows((r.text or "").encode())
        total = sum(map(evidence, words))
        x = sum(w * f for w, f in zip(model.weights, (total, 100 * total / (len(words) + 50), math.log1p(len(words)), 1.0)))
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-x))) < 1e-9


def test_the_model_beside_a_plain_count_of_its_marks(spark):
    """What README says of sf0.1: the compression lengths rank held-out rows better than a count of the words they are trained on."""
    from labelmill.llm import toxicity
    from tests.llm.test_llm_queries import auc

    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learnt = {r.doc_id: r.toxic for r in labels.where(remainder(5) != 0).collect()}
    held = {r.doc_id: r.toxic for r in labels.where(remainder(5) == 0).collect()}
    texts = {r.doc_id: toxicity.windows((r.text or "").encode()) for r in docs.join(labels, "doc_id").select("doc_id", "text").collect()}
    sides = [[texts[d] for d, y in learnt.items() if y == label and d in texts] for label in (1, 0)]
    toxic, ordinary = (Counter(w for s in side for w in s) for side in sides)
    need = max(3, toxicity.LEAST_SHARE * len(sides[0]))
    marks = {w for w, c in toxic.items() if c >= need and c / len(sides[0]) >= toxicity.LEAST_RATIO * (ordinary[w] + 1) / len(sides[1])}
    scores = {r.doc_id: r.score for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    model, count = (auc([(of(d), y) for d, y in held.items() if d in texts]) for of in (scores.get, lambda d: len(texts[d] & marks)))
    assert model >= 0.97 and 0.93 <= count < model
