"""Invariants of a whole run over extracts derived from the smallest tables."""

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.operators import quality
from ledgerloom.plans import catalog, medallion, publish
from ledgerloom.plans.rules import PUBLISHED_RULES
from ledgerloom.session import scratch_path
from ledgerloom.sources.manifest import fingerprint
from ledgerloom.sources.zones import Zones
from ledgerloom.workload.landing import land_extracts
from ledgerloom.workload.tables import Tables


@pytest.fixture(scope="module")
def lake(spark):
    tables = Tables(spark, SMALL)
    root = scratch_path(spark, "medallion-test")
    land_extracts(tables, f"{root}/landing")
    zones = Zones(spark, f"{root}/lake")
    counts = medallion.run(zones, tables.ctx, f"{root}/landing", enforce=False)
    return zones, tables, counts


def test_stage_names_are_checked(lake):
    zones, tables, _ = lake
    with pytest.raises(ValueError, match="platinum"):
        medallion.run(zones, tables.ctx, "", ["silver", "platinum"])


def test_every_table_is_written_and_recorded(lake):
    zones, _, counts = lake
    assert len(zones.tables("bronze")) == 9 and len(zones.tables("silver")) == 7
    assert zones.tables("gold") == ["credit_risk", "customer_360", "transaction"]
    assert zones.tables("ops") == ["catalog", "contract_problems", "dq_results", "fraud_ground_truth", "lineage_edges", "pipeline_runs", "sla_status"]
    assert zones.read("ops.pipeline_runs").count() == len(counts)
    assert all(counts[name] > 0 for name in counts)


def test_grain_and_vocabulary(lake):
    zones, _, counts = lake
    for name in ("gold.customer_360", "gold.credit_risk"):
        table = zones.read(name)
        assert table.select("customer_id").distinct().count() == table.count() == counts[name]
        assert table.count() == zones.read("silver.customers").filter("is_current").count()
    assert counts["gold.transaction"] == counts["silver.transactions"]
    assert zones.read("gold.customer_360").filter("customer_segment IS NULL OR risk_category IS NULL").isEmpty()


def test_contracts_and_tables_have_the_same_columns(lake):
    zones, _, _ = lake
    tables = {name: zones.read(f"gold.{name}") for name in catalog.CONTRACTS}
    found = publish.contract_problems(zones.spark, tables)
    # payments repeat their ids in the given data; nothing else is wrong
    assert rows(found, "product", "problem") == [("transaction", "primary key repeats")]
    without = publish.contract_problems(zones.spark, {"customer_360": tables["customer_360"].drop("age").withColumn("x", F.lit(1))})
    problems = {r["problem"] for r in without.collect()}
    assert {"declared column not published: age", "published column not declared: x", "gold table missing"} <= problems


def test_flags_follow_the_dispute_window(lake):
    zones, tables, _ = lake
    facts = zones.read("gold.transaction")
    assert facts.filter("fraud_label_status = 'PENDING' AND fraud_flag IS NOT NULL").isEmpty()
    assert facts.filter("fraud_label_status = 'CLEARED' AND fraud_flag").isEmpty()
    assert facts.filter((F.col("fraud_label_status") == "CLEARED") & (F.col("transaction_date") > tables.ctx.days_back(90))).isEmpty()


def test_quality_sla_and_catalogue(lake):
    zones, _, _ = lake
    results = zones.read("ops.dq_results")
    assert results.count() == 31 == len(PUBLISHED_RULES) and results.filter("status = 'ERROR'").isEmpty()
    sla = zones.read("ops.sla_status")
    assert rows(sla, "product", "freshness_ok", "age_hours") == [("credit_risk", True, 0.0), ("customer_360", True, 0.0), ("transaction", True, 0.0)]
    degraded = {r["product"] for r in sla.filter("status = 'DEGRADED'").collect()}
    critical = {r["dataset"].split(".")[1] for r in results.filter("status = 'FAIL' AND severity = 'critical' AND dataset LIKE 'gold.%'").collect()}
    assert degraded == critical
    status = publish.platform_status(publish.list_products(catalog.contract_table(zones.spark), sla)).first()
    assert status["products"] == 3 and set(status["degraded"]) == degraded and status["metrics"] == 28
    unknown = publish.list_products(catalog.contract_table(zones.spark), sla.limit(0))
    assert {r["status"] for r in unknown.collect()} == {"UNKNOWN"}


def test_a_critical_failure_stops_publication(lake):
    zones, tables, _ = lake
    assert quality.summary(zones.read("ops.dq_results")).first()["critical_failures"] > 0
    with pytest.raises(medallion.CriticalQualityFailure):
        medallion.publish_all(zones, tables.ctx)


def test_a_failing_run_leaves_the_published_products(lake):
    zones, tables, _ = lake
    before = zones.file_states()
    published = [s for s in before if "/gold/" in s[0] and "_candidate" not in s[0]]
    with pytest.raises(medallion.CriticalQualityFailure):
        medallion.run(zones, tables.ctx, f"{zones.root}/../landing", ["gold", "publish"])
    assert [s for s in zones.file_states() if "/gold/" in s[0] and "_candidate" not in s[0]] == published
    assert len(medallion.candidates(zones).tables("gold")) == 3


def test_readers_api(lake):
    zones, _, _ = lake
    assert api.sla(zones, "transaction").first()["sla_freshness_hours"] == 1
    assert api.lineage_of(zones, "customer_360").count() > 10
    assert ("bronze.s_bureau_credit_records",) in rows(api.upstream_sources(zones, "credit_risk"))
    answer = api.ask(zones, api.MetricRequest("credit_risk", ["default_rate"]))
    assert 0 <= answer.first()["default_rate"] <= 1


def test_two_builds_are_equal(lake):
    zones, tables, _ = lake
    again = Zones(zones.spark, scratch_path(zones.spark, "medallion-again"))
    names = ["silver.customers", "silver.loans", "silver.credit_records"]
    step = next(t for t in medallion.GOLD if t.output == "gold.credit_risk")
    again.write(step.output, step.build({n: zones.read(n) for n in names}, tables.ctx))
    assert fingerprint(again.read(step.output)).first() == fingerprint(zones.read(step.output)).first()
