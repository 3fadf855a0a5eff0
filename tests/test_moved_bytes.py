"""What is moved and written: edges once, products from written silver, narrow cuts."""

import os
import re

from conftest import SMALL, rows
from pyspark.sql import functions as F

from ledgerloom.operators import detectors, graph, quality
from ledgerloom.operators.quality import Rule
from ledgerloom.session import materialise
from ledgerloom.workload.registry import Published
from ledgerloom.workload.tables import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_edges_are_not_moved_again(spark):
    edges = spark.range(200).selectExpr("id % 50 AS node", "id % 100 AS dataset")
    hops, table = graph.bucketed(edges, "node")
    assert hops.count() == 100
    fresh = spark.range(50).withColumnRenamed("id", "node").hint("merge")
    met = plan(hops.join(fresh, "node"))
    assert met.count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {table}")


def test_reach_takes_repeated_edges_and_leaves_no_table(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "b")], "from_dataset string, to_dataset string")
    starts = spark.createDataFrame([("a",), (None,), ("a",)], "start string")
    before = {t.name for t in spark.catalog.listTables()}
    assert rows(graph.reach(edges, starts, "downstream")) == [("a", "b"), ("a", "c")]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_cut_is_compressed(spark):
    wide = spark.range(200_000).select("id", *[F.lit("the same long value in every row").alias(f"c{i}") for i in range(5)])
    cut = materialise(wide)
    size = sum(os.path.getsize(name.removeprefix("file://")) for name in cut.inputFiles())
    assert cut.count() == 200_000 and cut.dtypes == wide.dtypes and size < 4_000_000


def test_products_are_built_from_written_silver(spark, scratch):
    os.symlink(SMALL, f"{scratch}/data")
    store = Published(Tables(spark, f"{scratch}/data"))
    for name in ("silver.customers", "silver.accounts", "silver.transactions"):
        store.read(name)
    built = store._build("gold.transaction")
    assert not [name for name in built.inputFiles() if "lineitem" in name]
    assert "rangepartitioning" not in plan(built)
    names = store._build("gold.customer_360").inputFiles()
    assert [n for n in names if "/silver/accounts/" in n] and not [n for n in names if "customer.parquet" in n]
    fresh = Tables(spark, SMALL)
    assert rows(built) == rows(fresh.transaction) and rows(store.read("gold.customer_360")) == rows(fresh.customer_360)


def test_states_move_once_to_their_verdict(spark):
    rules = [Rule("t", "one", "unique", ("k",)), Rule("t", "some", "not_null", ("k",))]
    table = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    states = materialise(quality.rule_states(rules, {"t": table}).union(quality.rule_states(rules, {"t": table})))
    judged = quality.verdict(spark, rules, quality.merged_states(states), {"t": table})
    assert plan(judged).count("Exchange hashpartitioning(rule_id") <= 2  # by rule and key; by rule
    assert rows(judged, "rule_id", "rows_evaluated", "rows_failed") == [("one", 6, 4), ("some", 6, 2)]


def test_rings_move_their_rows_once(spark):
    ticks = spark.range(400).selectExpr("id", "id % 3 AS m", "1.5D AS a", "id % 7 AS c", "timestamp_seconds(id * 40000) AS at")
    named = dict(merchant="m", amount="a", card="c", ts="at", order=("id",), seconds=240_000, cards=2)
    ran = lambda df: plan(df).split("== Initial Plan ==")[0]

    rings = detectors.collusion_rings(ticks, **named)
    found = rows(rings)
    # no price is hot here, so the way for hot ones is gone from the plan that ran
    assert len(found) == 397 and ran(rings).count("Exchange hashpartitioning") == 1 and "__stretch" not in ran(rings)
    hot = detectors.collusion_rings(ticks, **named, hot_rows=10)
    assert rows(hot) == found and "__stretch" in ran(hot)


def test_keys_of_states_are_hashed_and_not_sorted(spark):
    rules = [Rule("t", "one", "unique", ("k",)), Rule("t", "new", "freshness", ("day",))]
    table = spark.sql("SELECT CAST(id AS STRING) AS k, DATE'2024-01-01' AS day, id % 3 AS batch FROM range(30)")
    states = materialise(quality.rule_states(rules, {"t": table}, by=("batch",)))
    for judged in (
        quality.verdict(spark, rules, quality.merged_states(states), {"t": table}), quality.verdict(spark, rules, states, {"t": table}, 500_000)
    ):
        assert not re.search(r"SortAggregate\(key=\[[^\]]*\bkey#", plan(judged))
        assert rows(judged, "rule_id", "rows_evaluated", "rows_failed") == [("new", 30, 0), ("one", 30, 0)]
    assert re.search(r"hashpartitioning\(place#\d+, key#\d+, 3\), REPARTITION_BY_NUM", plan(judged))  # 200,000 a task
    assert plan(judged).count("Exchange hashpartitioning(place") == 2  # by rule and key; by rule
