from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators.snapshots import drop_redelivered, latest_per_key, version_history

SNAPSHOT = "k string, b string, region string, city string, other string"
TRACKED = ["region", "city"]


def history(spark, data, **options):
    df = spark.createDataFrame(data, SNAPSHOT)
    return version_history(df, "k", "b", TRACKED, **options)


def test_versions_open_and_close_and_untracked_attributes_freeze(spark):
    got = history(
        spark,
        [
            ("a", "2024-01-01", "N", "x", "1"),
            ("a", "2024-02-01", "N", "x", "2"),
            ("a", "2024-03-01", "N", "y", "3"),
            ("a", "2024-04-01", "N", "x", "4"),
        ],
    )
    assert rows(got, "valid_from_batch", "valid_to_batch", "is_current", "version_no", "city", "other") == [
        ("2024-01-01", "2024-03-01", False, 1, "x", "1"),
        ("2024-03-01", "2024-04-01", False, 2, "y", "3"),
        ("2024-04-01", "9999-12", True, 3, "x", "4"),
    ]


def test_a_null_lead_attribute_before_forces_a_new_version(spark):
    got = history(
        spark,
        [("a", "1", None, "x", ""), ("a", "2", None, "x", ""), ("b", "1", "N", None, ""), ("b", "2", "N", None, "")],
    )
    assert rows(got, "k", "valid_from_batch") == [("a", "1"), ("a", "2"), ("b", "1")]


def test_a_repeated_delivery_of_one_batch_is_one_snapshot(spark):
    data = [("a", "1", "N", "x", "old"), ("a", "1", "N", "x", "new"), ("a", "2", "S", "x", "z")]
    got = history(spark, data, tie_break=["other"])
    assert rows(got, "valid_from_batch", "other", "version_no") == [("1", "old", 1), ("2", "z", 2)]


def test_latest_breaks_ties_by_later_names_and_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "2", 1), ("a", "2", 3), ("b", None, 9), ("b", "0", 1)], "k string, b string, n int")
    assert rows(latest_per_key(df, ["k"], ["b", "n"])) == [("a", "2", 3), ("b", "0", 1)]


def test_latest_limits_each_map_task_before_the_exchange(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = latest_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_redelivered_records_keep_the_newest_batch(spark):
    df = spark.createDataFrame([("h1", "1"), ("h1", "2"), ("h2", "1")], "_record_hash string, _batch_id string")
    assert rows(drop_redelivered(df)) == [("h1", "2"), ("h2", "1")]


def test_repeated_deliveries_of_a_batch_never_decide_at_random(spark):
    from ledgerloom.operators.products import account_totals, loan_totals
    from ledgerloom.operators.snapshots import latest_delivery

    table = [("k", "2024-01", 5, "z"), ("k", "2024-02", 2, "b"), ("k", "2024-02", 3, "a"), ("k", "2024-02", None, "c")]
    df = spark.createDataFrame(table, "key string, batch string, _ingested_at int, value string")
    for parts in (1, 3):
        got = latest_delivery(df.repartition(parts), ["key"], ["batch"], ["value", "absent"]).collect()
        assert [r.value for r in got] == ["a"]
        got = latest_delivery(df.drop("_ingested_at").repartition(parts), ["key"], ["batch"], ["value"]).collect()
        assert [r.value for r in got] == ["c"]

    schema = "account_id string, customer_id string, snapshot_batch string, account_type string, status string, balance double, overdraft_limit double, balance_anomaly_flag boolean, region_conflict_flag boolean"
    rows = [("a1", "c1", "2024-02", "SAVINGS", s, b, 0.0, False, False) for s, b in (("ACTIVE", 5.0), ("ACTIVE", 7.0), ("CLOSED", 1.0))]
    orders = [rows, rows[::-1], rows[1:] + rows[:1]]
    held = [account_totals(spark.createDataFrame(order, schema).coalesce(1)).collect() for order in orders]
    assert held[0] == held[1] == held[2] and held[0][0].account_count == 1

    schema = "loan_id string, customer_id string, snapshot_batch string, product string, status string, dpd int, principal double, outstanding_principal double, npa_flag boolean"
    rows = [("l1", "c1", "2024-02", "HOME", "ACTIVE", d, 9.0, o, d > 90) for d, o in ((0, 5.0), (95, 7.0), (30, 1.0))]
    held = [loan_totals(spark.createDataFrame(order, schema).coalesce(1)).collect() for order in (rows, rows[::-1])]
    assert held[0] == held[1] and held[0][0].dpd_max == 95 and held[0][0].loan_outstanding == 7.0
