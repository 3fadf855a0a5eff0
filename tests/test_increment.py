"""Incremental runs: only what a batch touches is rewritten, and the result is that of one run over everything."""

import random
import shutil
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.context import RunContext
from ledgerloom.operators import snapshots
from ledgerloom.operators.merges import VersionStore
from ledgerloom.plans import increment, medallion
from ledgerloom.sources import batches
from ledgerloom.sources.ingest import with_ingest_metadata
from ledgerloom.sources.zones import Zones
from ledgerloom.workload import landing as land
from ledgerloom.workload.tables import Tables
from conftest import SMALL, rows

TRACKED = ["region", "status"]
SNAP = "id string, region string, status string, income int, batch string"


def fold_data(seed, months=8, keys=30):
    rng = random.Random(seed)
    return {
        f"m{m:02d}": [
            (f"k{k}", rng.choice([None, "N", "N", "S"]), rng.choice(["A", "A", "A", "B", None]), rng.randint(0, 9), f"m{m:02d}")
            for k in range(keys)
            if rng.random() < 0.7
        ]
        for m in range(months)
    }


def history_of(spark, data):
    every = spark.createDataFrame([r for m in data.values() for r in m], SNAP)
    return rows(snapshots.version_history(every, "id", "batch", TRACKED, collapse=False), *COLUMNS)


COLUMNS = ["id", "region", "status", "income", "version_no", "valid_from_batch", "valid_to_batch", "is_current"]


def test_folding_snapshots_equals_the_history_of_all(spark, scratch):
    data = fold_data(1)
    store = VersionStore(Zones(spark, scratch), "bronze.versions", "id", TRACKED, buckets=4)
    for name, snap in data.items():
        store.apply(spark.createDataFrame(snap, SNAP).drop("batch"), name)
    assert rows(store.history(), *COLUMNS) == history_of(spark, data)
    assert rows(store.current(), "id") == rows(store.history().where("is_current"), "id")

    # One more key in a new batch: only its bucket is written, and no closed version of earlier batches.
    before = {str(p): p.stat().st_mtime_ns for p in Path(scratch).rglob("*.parquet")}
    data["m99"] = [("k1", "W", "Z", 1, "m99")]
    buckets = store.apply(spark.createDataFrame(data["m99"], SNAP).drop("batch"), "m99")
    after = {str(p): p.stat().st_mtime_ns for p in Path(scratch).rglob("*.parquet")}
    fresh = [p for p, t in after.items() if before.get(p) != t]
    assert len(buckets) == 1 and fresh and all(f"bucket={buckets[0]}/" in p for p in fresh)
    assert all("closed_in=m99" in p for p in fresh if "__closed" in p)
    assert rows(store.history(), *COLUMNS) == history_of(spark, data)

    # An old batch delivered again: the buckets of its keys are derived anew.
    data["m03"] = [(k, "E", s, 5, b) for k, _, s, _, b in data["m03"][:5]] + data["m03"][7:]
    every = spark.createDataFrame([r for m in data.values() for r in m], SNAP)
    store.rebuild(every, "batch", list(range(4)))
    assert rows(store.history(), *COLUMNS) == history_of(spark, data)


def test_newest_deliveries_are_those_of_the_whole_table(spark, scratch):
    rng = random.Random(2)
    data = [(str(rng.randint(0, 40)), i, f"b{rng.randint(0, 5)}") for i in range(200)]
    bronze = spark.createDataFrame(data, "_record_hash string, _source_file int, batch string")
    whole = rows(snapshots.drop_redelivered(bronze, batch="batch"))
    parts = [batches.newest_deliveries(bronze, of) for of in (["b0"], ["b1", "b4"], ["b2", "b3"], ["b5"])]
    assert sorted(r for p in parts for r in rows(p)) == sorted(whole)


# -- whole runs --------------------------------------------------------------------------------------------------------
AS_OF = date(1997, 6, 30)


def deliveries(spark):
    """{entity: {batch: rows}} of a few months of the small tables, with provenance columns."""
    t, out = Tables(spark, SMALL), {}
    for name, df in land.extracts(t).items():
        months = sorted(r[0] for r in df.select("_batch_id").distinct().collect())
        months = [m for m in months if "1997-01-01" <= m <= "1997-03-01"] or months[:3]
        df = df.drop("batch_year").where(F.col("_batch_id").isin(months))
        if name == "s_payments/payment_transactions":  # some of these ids come in several months
            df = df.dropDuplicates(["_record_hash"])
        df = df.cache()
        out[name] = {m: df.where(F.col("_batch_id") == m) for m in months}
    return out


def put(df, folder):
    df.coalesce(1).write.mode("overwrite").parquet(folder)


def deliver(found, folder, places):
    for name, months in found.items():
        for i, (month, df) in enumerate(months.items()):
            if i in places:
                put(df, f"{folder}/{name}/batch={month}")


@pytest.fixture(scope="module")
def found(spark):
    return deliveries(spark)


PRODUCTS = ("gold.customer_360", "gold.transaction", "gold.credit_risk")


def gold(zones):
    out = {}
    for name in PRODUCTS:
        df = zones.read(name)
        df = df.select(*sorted(c for c in df.columns if c != "_gold_updated_at"))
        out[name] = sorted(map(repr, df.collect()))
    return out


def whole_run(spark, scratch, landing, as_of=AS_OF):
    zones = Zones(spark, f"{scratch}/whole-{random.random()}")
    medallion.ingest_bronze(zones, landing)
    ctx = RunContext(as_of)
    medallion.build_silver(zones, ctx)
    medallion.build_gold(zones, ctx, landing)
    return gold(zones)


def test_incremental_runs_equal_a_whole_run(spark, scratch, found):
    landing, zones = f"{scratch}/landing", increment.LaidOut(spark, f"{scratch}/lake")
    put(Tables(spark, SMALL).labels, f"{landing}/_holdout/fraud_labels")
    run = lambda as_of=AS_OF: increment.run_increment(zones, RunContext(as_of), landing, buckets=2)
    deliver(found, landing, {0, 1})
    run()

    # A further month: only its folders in bronze, silver and the transaction product.
    deliver(found, landing, {2})
    written = run()
    months = {name: list(m)[2] for name, m in found.items() if len(m) > 2}
    for name, month in months.items():
        assert written[f"bronze.{name.replace('/', '_')}"] == [f"batch={month}"]
    assert written["silver.loans"] == [f"snapshot_batch={months['s_loans/loans']}"]
    assert all(f.rpartition("=")[2] in months.values() for f in written["silver.transactions"])
    assert {f.rpartition("=")[2] for f in written["gold.transaction"]} == {f.rpartition("=")[2] for f in written["silver.transactions"]}
    expected = whole_run(spark, scratch, landing)
    assert gold(zones) == expected

    # Nothing new, and a month delivered twice with the same rows: nothing is rewritten.
    assert run() == {}
    for name, batch in ((n, list(m)[1]) for n, m in list(found.items())[:4]):
        put(found[name][batch].orderBy(F.rand(1)), f"{landing}/{name}/batch={batch}")
    assert run() == {}
    assert gold(zones) == expected

    # An old month delivered again with other rows: its folders, and the gold rows of the customers touched.
    loans = found["s_loans/loans"]
    old = list(loans)[0]
    one = loans[old].orderBy("loan_id").first()["customer_id"]
    put(loans[old].withColumn("dpd", F.when(F.col("customer_id") == one, F.lit(99).cast("long")).otherwise(F.col("dpd"))), f"{landing}/s_loans/loans/batch={old}")
    crm = found["s_crm/customers"]
    first = list(crm)[0]
    put(crm[first].withColumn("region", F.when(F.col("customer_id") == one, "ATLANTIS").otherwise(F.col("region"))), f"{landing}/s_crm/customers/batch={first}")
    written = run()
    assert written["bronze.s_loans_loans"] == [f"batch={old}"] and written["silver.loans"] == [f"snapshot_batch={old}"]
    assert "silver.transactions" not in written and "gold.transaction" not in written
    assert gold(zones) == whole_run(spark, scratch, landing)

    # A later anchor: windows move, labels become available.
    later = date(2024, 3, 1)
    run(later)
    assert gold(zones) == whole_run(spark, scratch, landing, later)
    counts = medallion.publish_all(zones, RunContext(later), enforce=False)
    assert counts["ops.catalog"] == 3  # a published table shows no layout column
    assert {c for p in PRODUCTS for c in zones.read(p).columns}.isdisjoint({"bucket", "batch"})


def test_a_broken_run_is_taken_up_again(spark, scratch, found, monkeypatch):
    landing, zones = f"{scratch}/landing", increment.LaidOut(spark, f"{scratch}/lake")
    put(Tables(spark, SMALL).labels, f"{landing}/_holdout/fraud_labels")
    deliver(found, landing, {0, 1})
    increment.run_increment(zones, RunContext(AS_OF), landing, buckets=2)
    deliver(found, landing, {2})
    for place in ("by_batch", "customer_products"):
        with monkeypatch.context() as patch:
            def fail(*_):
                raise RuntimeError("lost")

            patch.setattr(increment.Increment, place, fail)
            with pytest.raises(RuntimeError):
                increment.run_increment(zones, RunContext(AS_OF), landing, buckets=2)
    increment.run_increment(zones, RunContext(AS_OF), landing, buckets=2)
    assert gold(zones) == whole_run(spark, scratch, landing)
    assert {e.state for e in batches.BatchLog(zones).entries().values()} == {batches.APPLIED}


def test_a_record_delivered_in_two_batches_counts_once(spark, scratch):
    zones, folder = Zones(spark, f"{scratch}/lake"), f"{scratch}/landing/t"

    def batch(name, records):
        df = spark.createDataFrame(records, "id int, v int")
        return with_ingest_metadata(df, source="s", entity="t", batch_id=name, ingested_at=land.INGESTED_AT, keys=["id"], source_file="f")

    def newest():
        bronze = zones.read("bronze.t")
        every = [r["batch"] for r in bronze.select("batch").distinct().collect()]
        return rows(batches.newest_deliveries(bronze, every), "id", "v", "batch")

    put(batch("b1", [(1, 10), (2, 20)]), f"{folder}/b1")
    put(batch("b2", [(3, 30)]), f"{folder}/b2")
    assert [e.touches for e in batches.land(zones, "bronze.t", folder)] == [(), ()]
    keyless = batch("b2", [(None, 1), (None, 2)])
    assert keyless.where(batches.has_key()).count() == 0
    put(batch("b3", [(2, 21), (4, 40)]), f"{folder}/b3")
    landed = batches.land(zones, "bronze.t", folder)
    assert {e.batch: e.touches for e in landed}["b3"] == ("b1",)
    assert newest() == [(1, 10, "b1"), (2, 21, "b3"), (3, 30, "b2"), (4, 40, "b3")]
    # Record 2 leaves the newer batch: the older one has it again, and is named as touched.
    put(batch("b3", [(4, 40)]), f"{folder}/b3")
    assert {e.batch: e.touches for e in batches.land(zones, "bronze.t", folder)}["b3"] == ("b1",)
    assert newest() == [(1, 10, "b1"), (2, 20, "b1"), (3, 30, "b2"), (4, 40, "b3")]
    shutil.rmtree(f"{folder}/b2")  # a folder that is gone is not a delivery
    assert newest()[2] == (3, 30, "b2")
