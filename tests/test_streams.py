"""Streams of events against the batch forms: cut into triggers, and begun again from the checkpoint."""

import random

from pyspark.sql import functions as F

from labelmill.streaming import admission
from tests.test_queries import DATA

DAY, BASE = 24 * 3600, 1_700_000_000


def put(df, folder, number):
    df.coalesce(1).write.parquet(f"{folder}/in/{number:04}")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(stream, folder):
    """Runs until all input is read; the sink and the checkpoint go on from an earlier call."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(300)
    assert run.exception() is None


def in_triggers(spark, folder, events, at, order, made, triggers=4):
    """The sink's rows after the events came in order, in so many triggers, with a new start half way."""
    rows = events.orderBy(at, order).collect()
    size = -(-len(rows) // triggers)
    for half in range(2):
        for k in range(half * triggers // 2, (half + 1) * triggers // 2):
            put(spark.createDataFrame(rows[k * size : (k + 1) * size], events.schema), folder, k)
        drain(made(source(spark, folder, events.schema)), folder)
    return spark.read.parquet(f"{folder}/out")


def seconds(rows):
    """Rows of (key, seconds since the base, order) as an event table, with columns whose names clash."""
    return rows.select("k", F.timestamp_seconds(F.col("s") + BASE).alias("ts"), "o", F.col("k").alias("event_t"), F.lit("x").alias("accepted_by"))


def test_accepted_stream_is_the_batch_form(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", (F.col("user_id") % 6).alias("user"), "event_type", "ts", "props", "value")
    keys = ["user", "event_type"]
    got = in_triggers(spark, tmp_path, events, "ts", "event_id", lambda s: admission.accepted_stream(s, keys, "ts", "event_id"))
    want = admission.accepted_first(events, keys, "ts", "event_id")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    taken = got.where("accepted").count()
    assert 50 < taken < got.count() - 50


def test_events_beyond_a_day_and_on_its_edge(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 25 * 3600, 2), ("a", 49 * 3600 - 1, 3), ("a", 49 * 3600, 4), ("b", 0, 5), ("b", DAY, 6), (None, 5, 7), (None, 6, 8)], "k string, s long, o long")
    events = seconds(rows)
    got = in_triggers(spark, tmp_path, events, "ts", "o", lambda s: admission.accepted_stream(s, ["k"], "ts", "o"), 8)
    accepted = {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}
    assert {r.o: r.accepted for r in got.collect()} == accepted
    assert {r.o: r.accepted for r in admission.accepted_first(events, ["k"], "ts", "o").collect()} == accepted
    assert not admission.follows_within(events, ["k"], "ts", "o").where("o = 6 AND is_repeat").count()


def plain_disputes(rows, least=3, span=30 * DAY):
    """rows: (key, seconds, order, protected)."""
    out, held = [], {}
    for k, s, _, protected in sorted(rows, key=lambda r: (r[1], r[2])):
        times, raised = held.get(k, ([], False))
        times = [t for t in times if t > s - span] + [s]
        if len(times) < least:
            raised = False
        elif not raised and not protected:
            raised = True
            out.append((k, s, times[-least]))
        held[k] = times, raised
    return sorted(out)


def told(df):
    return sorted((r.k, int(r.a), int(r.b)) for r in df.select("k", (F.unix_seconds("disputed_at") - BASE).alias("a"), (F.unix_seconds("first_report_at") - BASE).alias("b")).collect())


def test_disputes_come_once_for_three_reports_in_thirty_days(spark, tmp_path):
    rng = random.Random(8)
    rows = [("new year", 23 * 3600, 1, False), ("new year", 9 * DAY, 2, False), ("new year", 30 * DAY + 22 * 3600, 3, False)]
    rows += [("edge", 0, 4, False), ("edge", DAY, 5, False), ("edge", 30 * DAY, 6, False), ("edge", 30 * DAY + 1, 7, False)]
    rows += [("nine days", k * 3 * DAY, 10 + k, False) for k in range(4)]
    rows += [("admin", k * DAY, 20 + k, k < 5) for k in range(4)] + [("freed", k * DAY, 30 + k, k < 4) for k in range(6)]
    rows += [(f"r{rng.randint(0, 5)}", rng.randint(0, 200) * DAY // 2, 100 + k, rng.random() < 0.2) for k in range(150)]
    events = spark.createDataFrame(rows, "k string, s long, o long, p boolean").select("k", F.timestamp_seconds(F.col("s") + BASE).alias("ts"), "o", "p")
    want = plain_disputes(rows)
    assert {k for k, *_ in want} >= {"new year", "edge", "nine days", "freed"} and not any(k == "admin" for k, *_ in want)
    assert told(admission.disputes(events, "k", "ts", "o", F.col("p"))) == want
    got = in_triggers(spark, tmp_path, events, "ts", "o", lambda s: admission.dispute_stream(s, "k", "ts", "o", F.col("p")), 6)
    assert told(got) == want
    counted = admission.reports_in(events, "k", "ts").where("k = 'edge'").orderBy("o").collect()
    assert [r.n_reports for r in counted] == [1, 2, 2, 3]


def test_disputes_of_the_event_table(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'error'").select((F.col("user_id") % 9).alias("k"), "ts", "event_id")
    got = in_triggers(spark, tmp_path, events, "ts", "event_id", lambda s: admission.dispute_stream(s, "k", "ts", "event_id"))
    want = admission.disputes(events, "k", "ts", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    # Each row stands where the count of recent reports comes to three.
    shown = admission.reports_in(events, "k", "ts").where("n_reports = 3").select("k", F.col("ts").alias("disputed_at"))
    assert want.join(shown, ["k", "disputed_at"], "left_anti").count() == 0
