"""Governed metric queries: a structured request becomes one aggregate plan."""

from __future__ import annotations

import calendar
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import catalog
from ledgerloom.plans.catalog import Contract, Metric

# The usual length of a ranking, and the most rows that a ranking or a preview may ask for.
RANKING_LIMIT = 10
MAX_LIMIT = 1000
PREVIEW_ROWS = 200
# Operational tables a reader may name besides the products.
READABLE_OPS = ("dq_results", "lineage_edges", "sla_status", "pipeline_runs")
NEVER_READABLE = ("ops.fraud_ground_truth", "ops.fraud_labels")
DAYS_PER_UNIT = {"day": 1, "week": 7, "quarter": 91, "year": 365}

COMPARISONS = {
    "=": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


class RequestRefused(ValueError):
    """The request breaks a rule of the governed surface; ``code`` says which."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


# -- time windows ------------------------------------------------------------
@dataclass(frozen=True)
class TimeWindow:
    """Inclusive at both ends; either end may be open."""

    start: date | None
    end: date | None
    label: str


def shift_months(day: date, months: int) -> date:
    """Calendar shift; the day is clamped to the length of the target month."""
    year, month0 = divmod(day.year * 12 + day.month - 1 + months, 12)
    return date(year, month0 + 1, min(day.day, calendar.monthrange(year, month0 + 1)[1]))


def last(count: int, unit: str, anchor: date) -> TimeWindow:
    """The last N days, weeks, months, quarters or years up to the anchor."""
    if unit == "month":
        start = shift_months(anchor, -count)
    else:
        start = anchor - timedelta(days=DAYS_PER_UNIT[unit] * count)
    return TimeWindow(start, anchor, f"last {count} {unit}{'' if count == 1 else 's'}")


def last_calendar_month(anchor: date) -> TimeWindow:
    end = anchor.replace(day=1) - timedelta(days=1)
    return TimeWindow(end.replace(day=1), end, "last calendar month")


def month_to_date(anchor: date) -> TimeWindow:
    return TimeWindow(anchor.replace(day=1), anchor, "month to date")


def year_to_date(anchor: date) -> TimeWindow:
    return TimeWindow(anchor.replace(month=1, day=1), anchor, "year to date")


def calendar_year(year: int) -> TimeWindow:
    return TimeWindow(date(year, 1, 1), date(year, 12, 31), f"calendar year {year}")


def month_of_year(year: int, month: int) -> TimeWindow:
    end = date(year, month, calendar.monthrange(year, month)[1])
    return TimeWindow(date(year, month, 1), end, f"{calendar.month_name[month]} {year}")


def since(start: date, anchor: date) -> TimeWindow:
    return TimeWindow(start, anchor, f"since {start.isoformat()}")


def data_anchor(transactions: DataFrame, column: str = "transaction_date") -> DataFrame:
    """The newest event date; windows are anchored on data, not on today."""
    return transactions.agg(F.max(column).alias("anchor"))


# -- requests ----------------------------------------------------------------
@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class MetricRequest:
    """What a reader asks for. Without a ``limit`` every group is returned; a limit makes it a ranking."""

    product: str
    metrics: Sequence[str]
    dimensions: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    window: TimeWindow | None = None
    parameters: Mapping[str, object] = field(default_factory=dict)
    descending: bool = True
    limit: int | None = None
    #: Dimensions this reader's role may not group or rank by.
    forbidden_dimensions: frozenset[str] = frozenset()


@dataclass(frozen=True)
class MetricPlan:
    """A checked request: the columns to compute and what the reader should know."""

    contract: Contract
    dimensions: tuple[str, ...]
    aggregates: tuple[tuple[str, Metric], ...]
    predicate: Column | None
    descending: bool
    limit: int | None
    parameters: Mapping[str, object]
    notes: tuple[str, ...]


def check_dataset(dataset: str) -> None:
    """Only the published products and a few operational tables can be named."""
    name = dataset.lower()
    if name in NEVER_READABLE:
        raise RequestRefused("DATASET_FORBIDDEN", f"{name} is a restricted holdout")
    zone, dot, table = name.partition(".")
    if not dot:
        raise RequestRefused("SCHEMA_REQUIRED", f"'{name}' must be written as zone.table")
    if zone not in ("gold", "ops"):
        raise RequestRefused("SCHEMA_NOT_ALLOWED", f"zone '{zone}' is not readable")
    if table not in (catalog.CONTRACTS if zone == "gold" else READABLE_OPS):
        raise RequestRefused("TABLE_NOT_ALLOWED", f"'{name}' is not published")


def find_metric(name: str, product: str | None = None) -> Metric:
    metric = catalog.METRICS.get(name)
    if metric is None:
        raise RequestRefused("UNKNOWN_METRIC", f"'{name}' is not a governed metric")
    if product is not None and metric.product != product:
        raise RequestRefused("WRONG_PRODUCT", f"{metric.ref} belongs to {metric.product}")
    return metric


def metrics_named(phrase: str, product: str | None = None) -> list[Metric]:
    """Metrics a phrase names; more than one means the reader has to choose."""
    wanted = phrase.lower()
    return [
        m
        for m in catalog.METRICS.values()
        if (product is None or m.product == product) and wanted in (m.name, m.name.replace("_", " "), *m.synonyms)
    ]


def _predicate(contract: Contract, request: MetricRequest, notes: list[str]) -> Column | None:
    tests: list[Column] = []
    for f in request.filters:
        facts = contract.facts(f.column)
        if facts is None:
            raise RequestRefused("UNKNOWN_COLUMN", f"{contract.product} has no column '{f.column}'")
        if f.op not in COMPARISONS:
            raise RequestRefused("UNKNOWN_OPERATOR", f"'{f.op}' is not a supported comparison")
        enum = facts.get("enum")
        if enum and f.op == "=" and f.value not in enum:
            raise RequestRefused("VALUE_NOT_IN_ENUM", f"'{f.value}' is not one of {', '.join(enum)}")
        tests.append(COMPARISONS[f.op](F.col(f.column), F.lit(f.value)))
    if request.window is not None:
        if contract.time_column is None:
            notes.append(f"{contract.product} is a snapshot without an event date; the time window was not applied")
        else:
            when = F.col(contract.time_column)
            if request.window.start is not None:
                tests.append(when >= F.lit(request.window.start))
            if request.window.end is not None:
                tests.append(when <= F.lit(request.window.end))
    if not tests:
        return None
    combined = tests[0]
    for test in tests[1:]:
        combined = combined & test
    return combined


def _kept_metrics(contract: Contract, request: MetricRequest, notes: list[str]) -> list[Metric]:
    """Leave out what says nothing: row counts at key grain, and the same number twice."""
    metrics = [find_metric(name, contract.product) for name in request.metrics]
    if not metrics:
        raise RequestRefused("NO_METRIC", "a request names at least one metric")
    if set(contract.primary_key) <= set(request.dimensions):
        telling = [m for m in metrics if m.fingerprint != ("count", None)]
        if not telling:
            raise RequestRefused(
                "DEGENERATE_METRIC", f"a row count is 1 for every {', '.join(contract.primary_key)} of {contract.product}"
            )
        if len(telling) < len(metrics):
            notes.append("row counts dropped: the request is grouped at the primary key")
        metrics = telling
    seen: dict[tuple[str, str | None], Metric] = {}
    for metric in metrics:
        twin = seen.setdefault(metric.fingerprint, metric)
        if twin is not metric:
            notes.append(f"{metric.ref} dropped: identical aggregate to {twin.ref}")
    return list(seen.values())


def plan(request: MetricRequest) -> MetricPlan:
    """Check a request against contract, policy and registry; nothing is executed."""
    check_dataset(f"gold.{request.product}")
    contract = catalog.contract(request.product)
    notes: list[str] = []
    for name in request.dimensions:
        if contract.facts(name) is None:
            raise RequestRefused("UNKNOWN_COLUMN", f"{contract.product} has no column '{name}'")
        if name in request.forbidden_dimensions:
            raise RequestRefused("DIMENSION_FORBIDDEN", f"grouping or ranking by '{name}' is not permitted")
    metrics = _kept_metrics(contract, request, notes)
    for metric in metrics:
        if metric.name in catalog.CURRENCY_HAZARD:
            notes.append(f"{metric.ref} mixes currencies unless filtered or grouped by currency")
    aggregates = tuple((f"count_{m.name}" if m.name in request.dimensions else m.name, m) for m in metrics)
    if request.limit is not None and not 1 <= request.limit <= MAX_LIMIT:
        raise RequestRefused("LIMIT_OUT_OF_RANGE", f"a ranking has 1 to {MAX_LIMIT} rows, not {request.limit}")
    return MetricPlan(
        contract=contract,
        dimensions=tuple(request.dimensions),
        aggregates=aggregates,
        predicate=_predicate(contract, request, notes),
        descending=request.descending,
        limit=request.limit,
        parameters=request.parameters,
        notes=tuple(notes),
    )


def run(planned: MetricPlan, product: DataFrame) -> DataFrame:
    """The one aggregate query; dimensions break ties so that a limit is repeatable."""
    rows = product if planned.predicate is None else product.filter(planned.predicate)
    columns = [m.column(planned.parameters).alias(alias) for alias, m in planned.aggregates]
    lead = F.col(planned.aggregates[0][0])
    order = [lead.desc_nulls_last() if planned.descending else lead.asc_nulls_last()]
    order += [F.col(d).asc_nulls_last() for d in planned.dimensions]
    ranked = rows.groupBy(*planned.dimensions).agg(*columns).orderBy(*order)
    return ranked if planned.limit is None else ranked.limit(planned.limit)


def metric_query(request: MetricRequest, product: DataFrame) -> DataFrame:
    return run(plan(request), product)


@dataclass(frozen=True)
class Preview:
    rows: list[dict]
    row_count: int
    truncated: bool


def preview(result: DataFrame, limit: int = PREVIEW_ROWS) -> Preview:
    """At most ``limit`` rows for a reader; one more is fetched to know if any are left."""
    if not 1 <= limit <= MAX_LIMIT:
        raise RequestRefused("LIMIT_OUT_OF_RANGE", f"a preview has 1 to {MAX_LIMIT} rows, not {limit}")
    size = limit
    rows = [r.asDict(recursive=True) for r in result.limit(size + 1).collect()]
    return Preview(rows[:size], min(len(rows), size), len(rows) > size)
