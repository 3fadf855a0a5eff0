from datetime import date

import pytest
from conftest import rows

from ledgerloom.context import RunContext
from ledgerloom.operators import graph, policy
from ledgerloom.plans import catalog, medallion, publish

EDGES = "from_dataset string, to_dataset string, transform_id string"


@pytest.fixture
def edges(spark):
    # a diamond (d <- b, c <- a) and a cycle (a <- d)
    return spark.createDataFrame(
        [("bronze.a", "b", "t1"), ("bronze.a", "c", "t2"), ("b", "d", "t3"), ("c", "d", "t4"), ("d", "bronze.a", "t5")], EDGES
    )


def test_trace_crosses_every_edge_once_and_ends_on_cycles(edges):
    got = rows(graph.trace(edges, "d"), "level", "dataset", "transform_id")
    assert got == [(1, "b", "t3"), (1, "c", "t4"), (2, "bronze.a", "t1"), (2, "bronze.a", "t2"), (3, "d", "t5")]


def test_trace_depth_direction_and_roots(edges):
    assert rows(graph.trace(edges, "d", depth=1), "dataset") == [("b",), ("c",)]
    assert rows(graph.trace(edges, "b", "downstream", 2), "level", "dataset") == [(1, "d"), (2, "bronze.a")]
    assert rows(graph.roots(graph.trace(edges, "d"))) == [("bronze.a",)]
    with pytest.raises(ValueError):
        graph.trace(edges, "d", "sideways")


def test_reach_is_a_trace_from_every_start(spark, edges):
    links = [(f"n{i}", f"n{j}", "t") for i in range(90) for j in (i * 7 % 90, (i * i + 1) % 90) if i % 5]
    graphs = [edges, spark.createDataFrame([*links, *links[:9], (None, "n1", "t"), ("n2", None, "t")], EDGES)]
    for table, names in zip(graphs, (["bronze.a", "d", "nowhere", None, "d"], [f"n{i}" for i in range(0, 90)])):
        pairs = [(r.from_dataset, r.to_dataset) for r in table.collect()]
        for direction in ("upstream", "downstream"):
            ahead = {}
            for a, b in pairs:
                near, far = (b, a) if direction == "upstream" else (a, b)
                ahead.setdefault(near, set()).add(far)
            want = set()
            for name in {n for n in names if n}:
                todo, met = [name], set()
                while todo:
                    for far in ahead.get(todo.pop(), ()):
                        if far not in met:
                            met.add(far)
                            todo += [far] * (far is not None)
                want |= {(name, far) for far in met}
            starts = spark.createDataFrame([(n,) for n in names], "start string")
            got = [tuple(r) for r in graph.reach(table, starts, direction).collect()]
            assert set(got) == want and len(got) == len(want)
    assert graph.reach(edges, starts.limit(0)).isEmpty() and graph.reach(edges.limit(0), starts).isEmpty()


def test_a_trace_has_no_depth_limit(spark, monkeypatch):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}", "x") for i in range(12)] * 2, "from_dataset string, to_dataset string, transform_id string")
    assert rows(graph.trace(chain, "n0"), "dataset", "level")[-1] == ("n9", 9) and graph.trace(chain, "n0").count() == 12
    monkeypatch.setattr(graph, "SMALL_FRONTIER", 0)
    assert graph.trace(chain, "n0").count() == 12


def test_neighbours(edges):
    assert rows(graph.upstream_of(edges, "d")) == [("b",), ("c",)]
    assert rows(graph.downstream_of(edges, "bronze.a")) == [("b",), ("c",)]


def test_the_platform_lineage_has_twenty_edges_and_reaches_the_sources(spark):
    table = publish.lineage_edges(spark, medallion.ALL_JOBS, RunContext(date(2024, 1, 1)))
    assert table.count() == 20
    reached = rows(graph.roots(graph.trace(table, "gold.customer_360")))
    assert ("bronze.s_crm_customers",) in reached and len(reached) == 7


VERDICTS = [
    ("customer_360", "total_balance", "portfolio_analytics", True),
    ("credit_risk", "credit_score", "credit_assessment", True),
    ("transaction", "amount", "fraud_detection", True),
    ("customer_360", "credit_score", "marketing_targeting_on_credit_score", False),
    ("customer_360", "age", "marketing_targeting_on_age", False),
    ("credit_risk", "dti", "marketing_targeting", False),
    ("credit_risk", "risk_score", "automated_credit_decision", False),
    ("transaction", "fraud_flag", "customer_facing_scoring", False),
    # a narrower name of a prohibited use, spelled freely
    ("transaction", "amount", " Marketing targeting on SPEND", False),
    ("customer_360", "salary", "portfolio_analytics", False),
    # allow-list of the column; uses outside the product's own list are not refused
    ("transaction", "fraud_flag", "customer_analytics", False),
    ("transaction", "amount", "something_else", True),
    ("nowhere", "amount", "x", False),
]


def test_use_verdicts(spark):
    requests = spark.createDataFrame([v[:3] for v in VERDICTS], "product string, column string, use string")
    got = policy.verdicts(requests, policy.policy_table(spark))
    assert rows(got, "product", "column", "use", "allowed") == sorted(VERDICTS, key=lambda v: tuple((x is not None, str(x)) for x in v))


def test_a_refusal_names_the_contract_and_the_field(spark):
    allowed, reason = policy.check_use(spark, "gold.customer_360", "credit_score", "marketing_targeting_on_credit_score")
    assert not allowed and "customer_360@2.3.0" in reason and "not_allowed_use" in reason
    _, narrower = policy.check_use(spark, "transaction", "amount", "marketing_targeting_on_spend")
    assert "form of 'marketing_targeting'" in narrower
    _, unknown = policy.check_use(spark, "customer_360", "salary", "portfolio_analytics")
    assert "not part of" in unknown
    _, listed = policy.check_use(spark, "transaction", "fraud_flag", "customer_analytics")
    assert "restricted to fraud_detection" in listed


def test_verdicts_keep_the_requests_where_they_are(spark):
    requests = spark.range(10).selectExpr("if(id > 5, 'transaction', 'credit_risk') AS product", "'amount' AS column", "'x' AS use")
    plan = policy.verdicts(requests, policy.policy_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_the_contract_set_is_consistent():
    assert len(catalog.METRICS) == 28 and not catalog.dangling_metric_refs()
    assert [len(catalog.metrics_of(p)) for p in ("customer_360", "transaction", "credit_risk")] == [13, 7, 8]
    assert len(catalog.contract_digest()) == 16
    with pytest.raises(KeyError):
        catalog.contract("nope")
    assert catalog.contract("gold.customer-360").product == "customer_360"
