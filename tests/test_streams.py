from datetime import datetime, timedelta

from conftest import SMALL, rows
from pyspark.sql import functions as F

from ledgerloom.sources.zones import Zones
from ledgerloom.operators import conform, features, monitoring
from ledgerloom.streaming import streams
from ledgerloom.workload.tables import Tables

START = datetime(2024, 1, 1)


def test_alarms_fire_on_each_threshold(spark):
    calls = spark.createDataFrame(
        [("a", START, 20_001, 0, 0), ("b", START, 5, 3, 0), ("b", START + timedelta(minutes=4), 5, 2, 0), ("c", START, 5, 0, 1), ("d", START, 20_000, 4, 0)],
        "agent string, ts timestamp_ntz, latency_ms bigint, errors bigint, refusals bigint",
    )
    out = monitoring.alarms(monitoring.alarm_counts(calls, ["agent"]))
    assert rows(out, "agent", "latency_alarm", "error_alarm", "refusal_alarm") == [
        ("a", True, False, False), ("b", False, True, False), ("c", False, False, True),
    ]


def test_the_percentile_weighs_counted_latencies(spark):
    calls = spark.createDataFrame(
        [("a", START, v, 0, 0) for v in [10] * 90 + [1000] * 10], "agent string, ts timestamp_ntz, latency_ms bigint, errors bigint, refusals bigint"
    )
    assert monitoring.alarm_counts(calls, ["agent"]).first()["p95_ms"] == 1000.0


def test_long_features_and_their_merge(spark):
    wide = spark.createDataFrame([("C1", 5, None, "x"), ("C2", 6, 2.5, "y")], "customer_id string, n int, d double, s string")
    assert features.numeric_columns(wide, ["customer_id"]) == ["n", "d"]
    tall = features.long_features(wide)
    assert rows(tall) == [("C1", "n", 5.0), ("C2", "d", 2.5), ("C2", "n", 6.0)]
    day = lambda d: F.lit(datetime(2024, 1, d))
    merged = features.merged_features(
        tall.withColumn("updated_at", day(1)), tall.filter("customer_id = 'C1'").withColumns({"value": F.lit(9.0), "updated_at": day(2)})
    )
    assert rows(merged, "customer_id", "feature_name", "value") == [("C1", "n", 9.0), ("C2", "d", 2.5), ("C2", "n", 6.0)]


def events(spark):
    return streams.read_files(spark, f"{SMALL}/events.parquet", spark.read.parquet(f"{SMALL}/events.parquet").schema)


def test_the_conformed_stream_equals_the_batch(spark, scratch):
    stream = streams.conformed_card_stream(Tables.card_shape(events(spark)))
    streams.run_available(stream, f"{scratch}/out", f"{scratch}/offsets")
    batch = conform.conform_transactions(conform.card_rail(Tables(spark, SMALL).card_transactions))
    got = spark.read.schema(batch.schema).parquet(f"{scratch}/out")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_redelivered_records_are_dropped_once_across_runs(spark, scratch):
    shape = "_record_hash string, ts timestamp_ntz, n int"
    deliveries = [[("h1", START, 1), ("h2", START, 1), ("h1", START, 2)], [("h2", START + timedelta(minutes=5), 3), ("h3", START, 3)]]
    for i, batch in enumerate(deliveries):
        spark.createDataFrame(batch, shape).coalesce(1).write.parquet(f"{scratch}/in/{i}")
        source = spark.readStream.schema(shape).option("recursiveFileLookup", "true").parquet(f"{scratch}/in")
        unique = streams.deduplicated(source, "ts", "1 hour").select("_record_hash")
        streams.run_available(unique, f"{scratch}/out", f"{scratch}/offsets")
    assert rows(spark.read.parquet(f"{scratch}/out")) == [("h1",), ("h2",), ("h3",)]


def test_final_windows_of_the_stream_equal_the_batch(spark, scratch):
    stream = streams.activity_stream(events(spark), "user_id", amount="value", lateness="1 day")
    streams.run_available(stream, f"{scratch}/out", f"{scratch}/offsets")
    got = spark.read.schema(stream.schema).parquet(f"{scratch}/out")
    source = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    bound = source.agg(F.max("ts")).first()[0] - timedelta(days=1)
    batch = features.sliding_activity(source, "user_id", amount="value").filter(F.col("window_end") <= F.lit(bound))
    assert batch.count() > 0
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_feature_log_keeps_the_newest_value(spark, scratch):
    shape = "customer_id string, feature_name string, value double, updated_at timestamp"
    for i, value in enumerate([1.0, 2.0]):
        spark.createDataFrame([("C1", "f", value, START + timedelta(days=i))], shape).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(shape).parquet(f"{scratch}/in")
        streams.export_features(stream, f"{scratch}/log", f"{scratch}/offsets")
        assert rows(streams.read_features(spark, f"{scratch}/log"), "customer_id", "value") == [("C1", value)]
        streams.compact_features(spark, f"{scratch}/log")
        assert rows(streams.read_features(spark, f"{scratch}/log"), "customer_id", "value") == [("C1", value)]
    streams.compact_features(spark, f"{scratch}/log")
    kept = sorted(f.rsplit("/", 1)[1] for f in Zones(spark, f"{scratch}/log").folders())
    assert kept == ["snapshot=1"]
