"""Admission of submitted facts: gates, duplicate suppression, verification states, reports.

Each rule has a batch form over an event table and, where state is needed, a Structured
Streaming form with the same result for events that come in order. Spans of time are open: what is
exactly a day or 30 days old is past.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.streaming import processors

DAY, MONTH = 24 * 3600, 30 * 24 * 3600
LEAST_CONFIDENCE, SURE = 0.7, 0.9
REPORTS = 3


def gate(confidence: Column, warnings: Column, protected: Column, duplicate: Column) -> Column:
    """The first reason to reject a submission; null if it may pass. A calorie deviation only warns."""
    kinds = F.transform(warnings, lambda w: w["kind"])
    hard = F.filter(kinds, lambda k: ~k.isin("calorie_deviation", "mass_balance_exceeded"))
    return (
        F.when(F.coalesce(confidence, F.lit(0.0)) < LEAST_CONFIDENCE, F.lit("low_confidence"))
        .when(F.size(hard) > 0, F.lit("sanity_failed"))
        .when(F.array_contains(kinds, "mass_balance_exceeded"), F.lit("mass_balance"))
        .when(F.coalesce(protected, F.lit(False)), F.lit("public_source"))
        .when(F.coalesce(duplicate, F.lit(False)), F.lit("duplicate"))
    )


def follows_within(events: DataFrame, keys: list[str], at: str, order: str, seconds: int = DAY) -> DataFrame:
    """events with is_repeat: an earlier event of the same key is less than ``seconds`` old; ties go by ``order``.

    An event that old is in the same stretch of so many seconds or the one before, so a key's
    events are told apart by stretches and of the one before only its last time is carried over.
    A hot key is many groups.
    """
    time, span = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    rows = events.withColumns({"repeat_t": time, "repeat_span": F.floor(time / span)})
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    last = rows.where("repeat_t IS NOT NULL").groupBy(*keys, (F.col("repeat_span") + 1).alias("repeat_span")).agg(F.max("repeat_t").alias("repeat_last"))
    before = F.lag("repeat_t").over(Window.partitionBy(*keys, "repeat_span").orderBy("repeat_t", order))
    match = F.col("e.repeat_span") == F.col("l.repeat_span")
    for x in same:
        match = match & x
    joined = rows.withColumn("repeat_before", before).alias("e").join(last.alias("l"), match, "left")
    near = F.col("e.repeat_t") - F.coalesce("e.repeat_before", "l.repeat_last") < span
    return joined.select(*(F.col(f"e.`{c}`") for c in events.columns), F.coalesce(near, F.lit(False)).alias("is_repeat"))


def accepted_first(events: DataFrame, keys: list[str], at: str, order: str, seconds: int = DAY) -> DataFrame:
    """events with accepted: none of the same key that was itself accepted is less than ``seconds`` old.

    The rule refers to its own result, so each key's events are folded in order. They are sorted
    by Spark and stream through a task, which keeps the last accepted time of one key only; no
    key's events are gathered. Unknown times are never accepted.
    """
    gap = seconds * 1_000_000
    n, parts = len(events.columns), [f"p{i}" for i in range(len(keys))]
    # By place: a column of events may have any name.
    named = events.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(events.columns)), F.xxhash64(*keys).alias("h"), *(F.col(k).cast("string").alias(x) for k, x in zip(keys, parts)), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(order).alias("o"))
    rows = named.where("t IS NOT NULL").repartition("h").sortWithinPartitions("h", *parts, "t", "o")

    def work(batches):
        import pyarrow as pa

        key, last = None, 0
        for batch in batches:
            keep = []
            for *here, t in zip(*(batch.column(n + 1 + i).to_pylist() for i in range(len(parts) + 1))):
                new = here != key or t - last >= gap
                keep.append(new)
                if new:
                    key, last = here, t
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(keep, pa.bool_())], names=[*(f"c{i}" for i in range(n)), "accepted"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(events.schema)) + ", accepted boolean"
    folded = rows.mapInArrow(work, schema).unionByName(named.where("t IS NULL").select(*(f"c{i}" for i in range(n)), F.lit(False).alias("accepted")))
    return folded.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(events.columns)), "accepted")


def reports_in(events: DataFrame, key: str, at: str, seconds: int = MONTH, least: int = REPORTS) -> DataFrame:
    """events with n_reports (of the key in less than the time before, itself included) and disputed (at least ``least``).

    Each event also counts in the stretch of so many seconds after its own, so that a hot key is
    many groups, each with all that its events look back on.
    """
    time, micros = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    span = F.floor(time / micros)
    rows = events.withColumns({"report_t": time, "report_span": F.explode(F.when(time.isNull(), F.array(span)).otherwise(F.array(span, span + 1)))})
    w = Window.partitionBy(key, "report_span").orderBy("report_t").rangeBetween(1 - micros, 0)
    counted = rows.withColumn("n_reports", F.count("*").over(w)).where(F.col("report_span").eqNullSafe(F.floor(F.col("report_t") / micros)))
    return counted.drop("report_t", "report_span").withColumn("disputed", F.col("n_reports") >= least)


def verification(events: DataFrame, key: str, at: str, order: str, confidence: Column) -> DataFrame:
    """(key, status, verify_count) after all accepted submissions of a key, in order.

    The first one makes it partial if sure enough, else it stays unverified; a partial one with
    a count of at least 1 becomes verified and stays so. The status only depends on whether a
    sure submission came and whether another followed, so no fold or window is needed, but
    aggregates that combine before they are shuffled. Of submissions with one place in the order
    a sure one counts as the first.
    """
    places = events.select(key, F.col(at).alias("at"), F.col(order).alias("o"), confidence.alias("sureness")).groupBy(key, "at", "o").agg(F.count("*").alias("n"), F.max(F.coalesce("sureness", F.lit(0.0)) >= SURE).alias("sure"))
    place = F.struct("at", "o")
    total = places.groupBy(key).agg(F.sum("n").alias("verify_count"), F.max(place).alias("last"), F.min(F.when(F.col("sure"), F.struct(place.alias("place"), "n"))).alias("first"))
    status = F.when(F.col("first").isNull(), F.lit("unverified")).when((F.col("last") > F.col("first.place")) | (F.col("first.n") > 1), F.lit("verified")).otherwise(F.lit("partial"))
    return total.select(key, status.alias("status"), "verify_count")


def advance(products: DataFrame, submissions: DataFrame, key: str, at: str, order: str, confidence: Column) -> DataFrame:
    """products (key, verification, verify_count) after accepted submissions, taken in order.

    Each submission counts one up. It makes an unverified product partial if sure enough; a partial one
    whose count was at least 1 before it becomes verified; any other state stays. A null count stays null and
    verifies nothing. That needs no fold: what counts is how many submissions come, and at which place
    the first sure one does.
    """
    w = Window.partitionBy("k").orderBy("at", "o")
    placed = submissions.select(F.col(key).alias("k"), F.col(at).alias("at"), F.col(order).alias("o"), F.coalesce(confidence >= SURE, F.lit(False)).alias("sure")).withColumn("n", F.row_number().over(w))
    came = placed.groupBy(F.col("k").alias("came_to")).agg(F.count("*").alias("came"), F.min(F.when(F.col("sure"), F.col("n"))).alias("first_sure"))
    status, count = F.col("verification"), F.col("verify_count")
    new = (
        F.when((status == "unverified") & (F.col("first_sure") < F.col("came")) & count.isNotNull(), F.lit("verified"))
        .when((status == "unverified") & F.col("first_sure").isNotNull(), F.lit("partial"))
        .when((status == "partial") & ((F.col("came") > 1) & count.isNotNull() | (count >= 1)), F.lit("verified"))
        .otherwise(status)
    )
    joined = products.join(came, F.col(key) == F.col("came_to"), "left")
    changed = {"verification": F.when(F.col("came").isNotNull(), new).otherwise(status), "verify_count": (count + F.coalesce("came", F.lit(0))).cast(products.schema["verify_count"].dataType)}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in products.columns))


def stale(at: Column, as_of: Column, years: int = 2) -> Column:
    return F.coalesce(at < F.add_months(as_of, -12 * years), F.lit(False))


def _stateful(spark) -> None:
    """Arbitrary state needs the state store that keeps it on disk; set for the session's later queries."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def accepted_stream(stream: DataFrame, keys: list[str], at: str, order: str, seconds: int = DAY, late: str = "1 hour") -> DataFrame:
    """A stream with accepted, as ``accepted_first`` gives it for events that come in order, however they are cut into triggers.

    Each key has one number of state, its last accepted time, which a timer clears ``seconds`` and ``late``
    afterwards. An event that comes after a later one is judged by the last accepted time too; one
    later than the watermark is lost. An event without a time is never accepted and leaves no state.
    """
    _stateful(stream.sparkSession)
    n, parts = len(stream.columns), [f"p{i}" for i in range(len(keys))]
    # By place: a column of the stream may have any name.
    columns = [f"c{i}" for i in range(n)]
    time = F.col(at).cast("timestamp")
    rows = stream.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(stream.columns, columns)), *(F.col(k).alias(x) for k, x in zip(keys, parts)), time.alias("event_at"), F.unix_micros(time).alias("event_t"), F.col(order).alias("event_o")).withWatermark("event_at", late)
    schema = T.StructType([T.StructField(x, f.dataType) for x, f in zip(columns, stream.schema)] + [T.StructField("accepted", T.BooleanType())])
    known = rows.where("event_t IS NOT NULL").groupBy(*parts).transformWithState(processors.AcceptFirst(seconds * 1_000_000, columns), schema, "Append", "EventTime")
    return known.select(*(F.col(x).alias(c) for c, x in zip(stream.columns, columns)), "accepted")


def suppress_stream(stream: DataFrame, keys: list[str], at: str, order: str, seconds: int = DAY, late: str = "1 hour") -> DataFrame:
    """Only the accepted events of a stream."""
    return accepted_stream(stream, keys, at, order, seconds, late).where("accepted").drop("accepted")


def disputes(events: DataFrame, key: str, at: str, order: str, protected: Column | None = None, seconds: int = MONTH, least: int = REPORTS) -> DataFrame:
    """(key, disputed_at, first_report_at, n_reports): a row for each time that a key's reports reach ``least``.

    It comes with the report that does so; another one only after the number of recent reports fell below.
    While ``protected`` holds (set by an administrator, say) there is none; the first report
    after that may give it.
    """
    time, shown = F.unix_micros(F.col(at).cast("timestamp")), F.coalesce(protected if protected is not None else F.lit(False), F.lit(False))
    rows = events.select(F.col(key).alias("k"), time.alias("t"), F.col(order).alias("o"), shown.alias("protected")).where("t IS NOT NULL")
    w = Window.partitionBy("k").orderBy("t", "o")
    # The report that makes up the number is so many rows back; whether it is recent says if there are enough.
    rows = rows.withColumn("first_t", F.lag("t", least - 1).over(w))
    rows = rows.withColumn("enough", F.coalesce(F.col("t") - F.col("first_t") < seconds * 1_000_000, F.lit(False)))
    # A run of enough reports begins anew after each report that isn't; its first unprotected one gives the row.
    rows = rows.withColumn("run", F.sum((~F.col("enough")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    open_ones = rows.where("enough AND NOT protected").groupBy("k", "run").agg(F.min(F.struct("t", "o", "first_t")).alias("x"))
    return open_ones.select(F.col("k").alias(key), F.timestamp_micros("x.t").alias("disputed_at"), F.timestamp_micros("x.first_t").alias("first_report_at"), F.lit(least).cast("long").alias("n_reports"))


def dispute_stream(stream: DataFrame, key: str, at: str, order: str, protected: Column | None = None, seconds: int = MONTH, least: int = REPORTS, late: str = "1 hour") -> DataFrame:
    """What ``disputes`` gives, on a stream: a row as soon as a key's reports reach ``least``.

    State is the last ``least`` times of a key, however many it has; a timer clears it when the last is too old.
    """
    _stateful(stream.sparkSession)
    kind = stream.schema[key].dataType
    shown = F.coalesce(protected if protected is not None else F.lit(False), F.lit(False))
    time = F.col(at).cast("timestamp")
    rows = stream.select(F.col(key).alias("k"), time.alias("event_at"), F.unix_micros(time).alias("event_t"), F.col(order).alias("event_o"), shown.alias("protected")).withWatermark("event_at", late)
    schema = T.StructType([T.StructField("k", kind), T.StructField("t", T.LongType()), T.StructField("first_t", T.LongType()), T.StructField("n_reports", T.LongType())])
    raised = rows.where("event_t IS NOT NULL").groupBy("k").transformWithState(processors.Dispute(seconds * 1_000_000, least), schema, "Append", "EventTime")
    return raised.select(F.col("k").alias(key), F.timestamp_micros("t").alias("disputed_at"), F.timestamp_micros("first_t").alias("first_report_at"), "n_reports")


def verification_stream(stream: DataFrame, key: str, confidence: str) -> DataFrame:
    """(key, status, verify_count) of a stream of accepted submissions, by state kept per key.

    The key must be a long and the confidence a double. Each trigger gives the new state of the
    keys that it saw.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def work(k, frames, state):
        import pandas as pd

        status, count = state.get if state.exists else ("unverified", 0)
        for frame in frames:
            for sure in frame["sureness"]:
                if status == "partial" and count >= 1:
                    status = "verified"
                elif status == "unverified" and sure is not None and sure >= SURE:
                    status = "partial"
                count += 1
        state.update((status, count))
        yield pd.DataFrame({"key": [k[0]], "status": [status], "verify_count": [count]})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(confidence).cast("double").alias("sureness"))
    return rows.groupBy("key").applyInPandasWithState(work, "key long, status string, verify_count long", "status string, n long", "append", GroupStateTimeout.NoTimeout)
