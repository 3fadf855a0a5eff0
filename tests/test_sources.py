from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.sources import ingest, manifest
from ledgerloom.sources.zones import EmptyOutputError, Zones


@pytest.fixture
def zones(spark, scratch):
    return Zones(spark, f"{scratch}/lake")


def test_write_replaces_and_read_unites_columns_by_name(spark, zones):
    assert zones.write("silver.t", spark.range(5)) == 5
    assert zones.write("silver.t", spark.range(2)) == 2
    assert zones.read("silver.t").count() == 2
    path = zones.path("bronze.drift")
    spark.range(1).write.parquet(f"{path}/a")
    zones.write("bronze.d", spark.range(1))
    spark.range(1).selectExpr("id", "'x' AS extra").write.mode("append").parquet(zones.path("bronze.d"))
    assert rows(zones.read("bronze.d"), "id", "extra") == [(0, None), (0, "x")]


def test_only_the_given_partitions_are_replaced(spark, zones):
    batches = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "v int, _batch_id string")
    zones.write("bronze.b", batches, partition_by=["_batch_id"])
    again = spark.createDataFrame([(9, "2024-02-01")], "v int, _batch_id string")
    zones.write("bronze.b", again, partition_by=["_batch_id"], only_these_partitions=True)
    assert rows(zones.read("bronze.b"), "v", "_batch_id") == [(1, "2024-01-01"), (9, "2024-02-01")]


def test_listing_guard_and_errors(spark, zones):
    assert zones.tables("gold") == [] and not zones.exists("gold.t")
    zones.write("gold.t", spark.range(1))
    assert zones.tables("gold") == ["t"] and zones.exists("gold.t")
    with pytest.raises(FileNotFoundError):
        zones.read("gold.nothing")
    with pytest.raises(ValueError):
        zones.path("attic.t")
    with pytest.raises(EmptyOutputError):
        zones.write("gold.e", spark.range(0), allow_empty=False)


def test_registered_tables_are_seen_by_sql_and_follow_rewrites(spark, zones):
    zones.write("silver.reg", spark.range(3))
    assert zones.register_all() == ["silver.reg"]
    assert spark.sql("SELECT count(*) FROM silver.reg").first()[0] == 3
    zones.write("silver.reg", spark.range(7))
    zones.register("silver.reg")
    assert spark.sql("SELECT count(*) FROM silver.reg").first()[0] == 7


def test_united_batches_have_all_columns_in_alphabetical_order(spark):
    old, new = spark.createDataFrame([(1, "a")], "z int, b string"), spark.createDataFrame([(2, "b", 3)], "z int, b string, a int")
    out = ingest.united([old, new])
    assert out.columns == ["a", "b", "z"] and rows(out) == [(None, "a", 1), (3, "b", 2)]
    assert dict(out.dtypes)["a"] == "int"


def test_ingest_flattens_batch_folders_and_keeps_drifted_columns(spark, zones, scratch):
    folder = f"{scratch}/landing/s_crm/customers"
    with pytest.raises(FileNotFoundError):
        ingest.ingest(zones, "bronze.c", folder)
    spark.createDataFrame([("C1",)], "id string").write.parquet(f"{folder}/batch_month=2024-01")
    spark.createDataFrame([("C2", "en")], "id string, lang string").write.parquet(f"{folder}/batch_month=2024-02")
    assert ingest.ingest(zones, "bronze.c", folder) == 2
    out = zones.read("bronze.c")
    assert out.columns == ["id", "lang"] and rows(out) == [("C1", None), ("C2", "en")]
    assert ingest.ingest_labels(zones, f"{scratch}/landing") == 0


def test_incremental_ingest_takes_each_file_once(spark, zones, scratch):
    for i in range(2):
        spark.range(i, i + 1).coalesce(1).write.parquet(f"{scratch}/in/{i}")
        ingest.ingest_new_files(zones, "bronze.inc", f"{scratch}/in", f"{scratch}/offsets")
    assert rows(spark.read.parquet(zones.path("bronze.inc"))) == [(0,), (1,)]


def test_ingest_metadata(spark, scratch):
    spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "k int, v string").write.parquet(f"{scratch}/t")
    out = ingest.with_ingest_metadata(
        spark.read.parquet(f"{scratch}/t"), source="s", entity="e", batch_id="2024-01-01", ingested_at=datetime(2024, 1, 5), keys=["k"]
    )
    first = out.filter("v = 'b'").first()
    assert first["_source_system"] == "s/e" and first["_batch_id"] == "2024-01-01" and scratch in first["_source_file"]
    assert out.filter("k = 1").select("_record_hash").distinct().count() == 1
    assert dict(out.dtypes)["_record_hash"] == "string"


def fingerprint(df):
    return tuple(manifest.fingerprint(df).first())


def test_fingerprints_ignore_order_but_not_values_or_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    base = fingerprint(df)
    assert base[0] == 2 and len(base[1]) == 32
    assert fingerprint(df.orderBy(F.desc("n")).select("s", "n").repartition(3)) == base
    assert fingerprint(df.withColumn("s", F.lit("a"))) != base
    pair = spark.createDataFrame([(7, "x"), (7, "x")], "n int, s string")
    other = spark.createDataFrame([(8, "y"), (8, "y")], "n int, s string")
    assert fingerprint(pair) != fingerprint(other)  # XOR alone would cancel both
    assert fingerprint(df.limit(0))[1] == "empty"


def test_manifest_per_batch(spark):
    df = spark.createDataFrame([(1, "b1"), (2, "b1"), (1, "b2")], "n int, _batch_id string")
    out = manifest.batch_manifest(df)
    assert rows(out, "batch", "rows", "columns") == [("b1", 2, "_batch_id,n"), ("b2", 1, "_batch_id,n")]
    assert out.select("fingerprint").distinct().count() == 2


def test_a_widened_type_is_united(spark, scratch):
    spark.range(3).selectExpr("CAST(id AS INT) AS n").write.parquet(f"{scratch}/x/batch_month=2024-01")
    later = spark.range(5_000_000_000, 5_000_000_002).selectExpr("id AS n", "'b' AS extra")
    later.write.parquet(f"{scratch}/x/batch_month=2024-02")
    got = ingest.read_extracts(spark, f"{scratch}/x")
    assert dict(got.dtypes) == {"extra": "string", "n": "bigint"} and got.agg({"n": "max"}).first()[0] == 5_000_000_001
