from datetime import date

import pytest
from conftest import rows

from ledgerloom.operators import search
from ledgerloom.plans import metric_query as mq
from ledgerloom.plans.metric_query import Filter, MetricRequest, RequestRefused


@pytest.fixture
def product(spark):
    return spark.createDataFrame(
        [("C1", "N", "Mass", 10.0, 700), ("C2", "N", "Mass", 20.0, None), ("C3", "S", "HNI", 90.0, 650), ("C4", None, "HNI", 5.0, 800)],
        "customer_id string, region string, customer_segment string, total_balance double, credit_score int",
    )


def refused(request):
    with pytest.raises(RequestRefused) as caught:
        mq.plan(request)
    return caught.value.code


def test_grouped_query_orders_by_the_first_metric_then_by_dimension(product):
    out = mq.metric_query(MetricRequest("customer_360", ["customer_count", "total_balance"], ["region"]), product)
    assert [tuple(r) for r in out.collect()] == [("N", 2, 30.0), ("S", 1, 90.0), (None, 1, 5.0)]


def test_shapes(product):
    one = lambda *m, **k: mq.metric_query(MetricRequest("customer_360", list(m), **k), product).collect()
    assert one("avg_balance_per_customer")[0][0] == 31.25
    assert one("credit_score")[0][0] == pytest.approx(716.6667, abs=1e-4)
    assert one("high_value_customer", parameters={"threshold": 20})[0][0] == 2
    assert one("customer_count", filters=[Filter("credit_score", ">=", 700)])[0][0] == 2
    top = one("total_balance", dimensions=["customer_id"], limit=2)
    assert [r["customer_id"] for r in top] == ["C3", "C2"]
    bottom = one("total_balance", dimensions=["customer_id"], limit=1, descending=False)
    assert bottom[0]["customer_id"] == "C4"


def test_a_required_parameter_is_never_assumed(product):
    with pytest.raises(ValueError, match="threshold"):
        mq.metric_query(MetricRequest("customer_360", ["high_value_customer"]), product)


def test_a_metric_named_like_a_dimension_is_renamed(product):
    out = mq.metric_query(MetricRequest("customer_360", ["customer_segment"], ["customer_segment"]), product)
    assert out.columns == ["customer_segment", "count_customer_segment"]


def test_limits():
    limit = lambda **k: mq.plan(MetricRequest("customer_360", ["total_balance"], **k)).limit
    assert limit() is None and limit(dimensions=["region"]) is None and limit(limit=7) == 7
    for wrong in (0, 1001):
        with pytest.raises(RequestRefused) as refused:
            limit(limit=wrong)
        assert refused.value.code == "LIMIT_OUT_OF_RANGE"


def test_row_counts_say_nothing_at_key_grain_and_twins_are_dropped():
    assert refused(MetricRequest("customer_360", ["customer_count"], ["customer_id"])) == "DEGENERATE_METRIC"
    kept = mq.plan(MetricRequest("customer_360", ["customer_count", "total_balance"], ["customer_id"]))
    assert [m.name for _, m in kept.aggregates] == ["total_balance"] and kept.notes
    twins = mq.plan(MetricRequest("customer_360", ["customer_count", "risk_category"], ["region"]))
    assert [m.name for _, m in twins.aggregates] == ["customer_count"] and "identical" in twins.notes[0]


def test_what_is_refused():
    assert refused(MetricRequest("customer_360", ["txn_count"])) == "WRONG_PRODUCT"
    assert refused(MetricRequest("customer_360", ["nope"])) == "UNKNOWN_METRIC"
    assert refused(MetricRequest("customer_360", [])) == "NO_METRIC"
    assert refused(MetricRequest("salaries", ["customer_count"])) == "TABLE_NOT_ALLOWED"
    assert refused(MetricRequest("customer_360", ["customer_count"], ["shoe_size"])) == "UNKNOWN_COLUMN"
    assert refused(MetricRequest("customer_360", ["customer_count"], filters=[Filter("risk_category", "=", "Odd")])) == "VALUE_NOT_IN_ENUM"
    hidden = frozenset({"customer_id"})
    assert refused(MetricRequest("transaction", ["txn_amount_sum"], ["customer_id"], forbidden_dimensions=hidden)) == "DIMENSION_FORBIDDEN"
    codes = {}
    for name in ("ops.fraud_ground_truth", "silver.customers", "orders", "ops.secrets", "gold.nope"):
        with pytest.raises(RequestRefused) as caught:
            mq.check_dataset(name)
        codes[name] = caught.value.code
    assert list(codes.values()) == ["DATASET_FORBIDDEN", "SCHEMA_NOT_ALLOWED", "SCHEMA_REQUIRED", "TABLE_NOT_ALLOWED", "TABLE_NOT_ALLOWED"]
    mq.check_dataset("ops.dq_results")


def test_notes_on_currency_and_on_windows_a_snapshot_cannot_have():
    assert "currenc" in mq.plan(MetricRequest("transaction", ["net_flow"])).notes[0]
    snapshot = mq.plan(MetricRequest("customer_360", ["total_balance"], window=mq.calendar_year(2024)))
    assert snapshot.predicate is None and "snapshot" in snapshot.notes[0]


def test_contended_phrases_need_a_product():
    assert len(mq.metrics_named("risk band")) == 2
    assert [m.name for m in mq.metrics_named("risk band", "credit_risk")] == ["risk_band"]


@pytest.mark.parametrize(
    ("window", "start", "end"),
    [
        (mq.last(3, "month", date(2024, 5, 31)), date(2024, 2, 29), date(2024, 5, 31)),
        (mq.last(1, "month", date(2024, 1, 31)), date(2023, 12, 31), date(2024, 1, 31)),
        (mq.last(2, "quarter", date(2024, 5, 31)), date(2023, 12, 1), date(2024, 5, 31)),
        (mq.last(1, "year", date(2024, 5, 31)), date(2023, 6, 1), date(2024, 5, 31)),
        (mq.last(2, "week", date(2024, 5, 31)), date(2024, 5, 17), date(2024, 5, 31)),
        (mq.last_calendar_month(date(2024, 3, 15)), date(2024, 2, 1), date(2024, 2, 29)),
        (mq.month_to_date(date(2024, 3, 15)), date(2024, 3, 1), date(2024, 3, 15)),
        (mq.year_to_date(date(2024, 3, 15)), date(2024, 1, 1), date(2024, 3, 15)),
        (mq.month_of_year(2023, 12), date(2023, 12, 1), date(2023, 12, 31)),
        (mq.since(date(2024, 1, 2), date(2024, 3, 15)), date(2024, 1, 2), date(2024, 3, 15)),
    ],
)
def test_windows(window, start, end):
    assert (window.start, window.end) == (start, end)


def test_windows_include_both_ends(spark):
    days = spark.createDataFrame([(date(2024, 1, d), 1.0) for d in (1, 2, 3, 4)], "transaction_date date, amount double")
    request = MetricRequest("transaction", ["txn_count"], window=mq.TimeWindow(date(2024, 1, 2), date(2024, 1, 3), ""))
    assert mq.metric_query(request, days).first()[0] == 2
    assert mq.data_anchor(days).first()[0] == date(2024, 1, 4)


def test_preview_tells_when_more_is_left(product):
    cut = mq.preview(product, 3)
    assert (cut.row_count, cut.truncated, len(cut.rows)) == (3, True, 3)
    assert not mq.preview(product, 4).truncated


def resolve(spark, term, product=None):
    df = spark.createDataFrame([(term,)], "term string")
    row = search.resolve_terms(df, "term", product=product).first()
    return row["status"], row["resolved_ref"], [(c["metric"], c["score"]) for c in row["candidates"]]


def test_terms_resolve_by_name_synonym_phrase_and_words(spark):
    assert resolve(spark, "Total balance")[2][0] == ("total_balance", 1.0)
    status, ref, found = resolve(spark, "card spend")
    assert (status, ref, found[0]) == ("resolved", "metric.card_spend_90d@1.1.0", ("card_spend_90d", 0.95))
    status, ref, found = resolve(spark, "risk")
    assert status == "ambiguous" and ref is None
    assert {"risk_category", "risk_score", "risk_band"} <= {m for m, _ in found}
    assert resolve(spark, "zzzqqq nonexistent thing") == ("unresolved", None, [])
    scoped = resolve(spark, "outstanding", "credit_risk")[2]
    assert scoped and {m for m, _ in scoped} <= {"total_outstanding", "collateral_coverage", "obligation_monthly"}
    # one shared word of two: .45 / 2 + .1 is too little, two of two are enough
    assert resolve(spark, "observed zebra")[0] == "unresolved"
    assert resolve(spark, "worst observed")[2] == [("dpd_max_12m", 0.65)]


def test_products_are_ranked_by_shared_words(spark):
    ranked = search.search_products(spark, "how many customers by region")
    assert ranked.first()["product"] == "customer_360"
    assert len(search.search_products(spark, "").collect()) == 3
    assert rows(search.search_products(spark, "who spends the most on cards, by merchant"), "product")
