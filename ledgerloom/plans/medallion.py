"""Landing files to published products, as functions over a lake."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerloom.context import RunContext
from ledgerloom.operators import conform, products, quality
from ledgerloom.plans import catalog, publish
from ledgerloom.plans.rules import PUBLISHED_RULES
from ledgerloom.sources import ingest
from ledgerloom.sources.releases import Release, Releases
from ledgerloom.sources.zones import Zones

Tables = Mapping[str, DataFrame]


class CriticalQualityFailure(RuntimeError):
    """Published data breaks a critical rule; nothing downstream should use it."""


@dataclass(frozen=True)
class Transform:
    """One output table, the tables it may see, and the plan between them."""

    output: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    #: Columns the written files are clustered by, for file skipping on read.
    cluster_by: tuple[str, ...] = ()

    @property
    def job(self) -> publish.Job:
        return publish.Job(self.output.replace(".", "_"), self.output, self.inputs)


CRM, ACCOUNTS, CORE = "bronze.s_crm_customers", "bronze.s_core_accounts", "bronze.s_core_transactions"
CARDS, CARD_TXNS = "bronze.s_cards_cards", "bronze.s_cards_card_transactions"
PAYMENTS, LOANS = "bronze.s_payments_payment_transactions", "bronze.s_loans_loans"
REPAYMENTS, BUREAU = "bronze.s_loans_repayments", "bronze.s_bureau_credit_records"

SILVER: tuple[Transform, ...] = (
    Transform("silver.customers", (CRM,), lambda t, c: conform.silver_customers(t[CRM], c)),
    Transform("silver.accounts", (ACCOUNTS, CRM), lambda t, c: conform.silver_accounts(t[ACCOUNTS], t[CRM], c)),
    Transform(
        "silver.transactions",
        (CORE, CARD_TXNS, PAYMENTS),
        lambda t, c: conform.silver_transactions(t[CORE], t[CARD_TXNS], t[PAYMENTS], c),
    ),
    Transform("silver.cards", (CARDS,), lambda t, c: conform.silver_cards(t[CARDS], c)),
    Transform("silver.loans", (LOANS,), lambda t, c: conform.silver_loans(t[LOANS], c)),
    Transform("silver.credit_records", (BUREAU,), lambda t, c: conform.silver_credit_records(t[BUREAU], c)),
    Transform("silver.repayments", (REPAYMENTS,), lambda t, c: conform.silver_repayments(t[REPAYMENTS], c)),
)

GOLD: tuple[Transform, ...] = (
    Transform(
        "gold.customer_360",
        ("silver.customers", "silver.accounts", "silver.loans", "silver.transactions", "silver.credit_records"),
        lambda t, c: products.customer_360(
            t["silver.customers"], t["silver.accounts"], t["silver.loans"], t["silver.transactions"],
            t["silver.credit_records"], c,
        ),
    ),
    Transform(
        "gold.transaction",
        ("silver.transactions", ingest.HOLDOUT),
        lambda t, c: products.transaction_product(t["silver.transactions"], t[ingest.HOLDOUT], c),
        cluster_by=("transaction_date", "transaction_id"),
    ),
    Transform(
        "gold.credit_risk",
        ("silver.customers", "silver.loans", "silver.credit_records"),
        lambda t, c: products.credit_risk(t["silver.customers"], t["silver.loans"], t["silver.credit_records"], c),
    ),
)

ALL_JOBS: tuple[publish.Job, ...] = tuple(t.job for t in (*SILVER, *GOLD))


def together(steps: Mapping[str, Callable[[], int]]) -> dict[str, int]:
    """Run independent writes at once, so that small jobs do not leave executors idle."""
    with ThreadPoolExecutor(max(len(steps), 1)) as pool:
        running = {name: pool.submit(step) for name, step in steps.items()}
        return {name: future.result() for name, future in running.items()}


def ingest_bronze(zones: Zones, landing: str) -> dict[str, int]:
    def copy(source: str, entity: str) -> Callable[[], int]:
        return lambda: ingest.ingest(zones, f"bronze.{source}_{entity}", f"{landing}/{source}/{entity}")

    return together(
        {f"bronze.{s}_{e}": copy(s, e) for s, entities in ingest.SOURCES.items() for e in entities}
    )


def candidates(zones: Zones) -> Zones:
    """Where products wait for the verdict on them, beside the lake that readers see."""
    return Zones(zones.spark, f"{zones.root}/_candidate")


def _write(zones: Zones, step: Transform, ctx: RunContext, into: Zones) -> int:
    frame = step.build({name: zones.read(name) for name in step.inputs}, ctx)
    if step.cluster_by:
        frame = frame.repartitionByRange(*step.cluster_by)
    return into.write(step.output, frame, allow_empty=False)


def _build(zones: Zones, transforms: Sequence[Transform], ctx: RunContext, into: Zones | None = None) -> dict[str, int]:
    """The transforms of one layer do not depend on each other."""
    return together({t.output: (lambda t=t: _write(zones, t, ctx, into or zones)) for t in transforms})


def build_silver(zones: Zones, ctx: RunContext) -> dict[str, int]:
    return _build(zones, SILVER, ctx)


def build_gold(
    zones: Zones, ctx: RunContext, landing: str | None = None, *, into: Zones | None = None
) -> dict[str, int]:
    """The products; labels are loaded first when a landing folder is given."""
    labels = {} if landing is None else {ingest.HOLDOUT: ingest.ingest_labels(zones, landing)}
    return {**labels, **_build(zones, GOLD, ctx, into)}


def publish_all(zones: Zones, ctx: RunContext, *, enforce: bool = True, waiting: Zones | None = None) -> dict[str, int]:
    """Quality results, contract check, lineage, SLA and catalogue; raises on a critical failure.

    The operational tables are written before the verdict, so that a failed run can be
    explained from them. Products in ``waiting`` are judged there and take the place of
    the published ones only after the verdict; a failed run leaves those as they were.
    """
    spark = zones.spark
    named = sorted({r.dataset for r in PUBLISHED_RULES} | {r.reference for r in PUBLISHED_RULES if r.reference})

    def home(name: str) -> Zones:
        return waiting if waiting is not None and waiting.exists(name) else zones

    tables = {name: home(name).read(name) for name in named if home(name).exists(name)}
    gold = {c.product: tables[c.dataset] for c in catalog.CONTRACTS.values() if c.dataset in tables}
    evaluated = quality.stamped_results(quality.evaluate(spark, PUBLISHED_RULES, tables), ctx)
    counts = together(
        {
            "ops.dq_results": lambda: zones.write("ops.dq_results", evaluated.coalesce(1)),
            "ops.contract_problems": lambda: zones.write(
                "ops.contract_problems", publish.contract_problems(spark, gold).coalesce(1)
            ),
            "ops.lineage_edges": lambda: zones.write(
                "ops.lineage_edges", publish.lineage_edges(spark, ALL_JOBS, ctx)
            ),
        }
    )
    results = zones.read("ops.dq_results")
    states = [
        publish.product_state(c.product, tables[c.dataset], c.freshness_hours, c.sla_availability)
        for c in catalog.CONTRACTS.values()
        if c.dataset in tables
    ]
    counts["ops.sla_status"] = zones.write("ops.sla_status", publish.sla_status(states, results, ctx).coalesce(1))
    counts["ops.catalog"] = zones.write(
        "ops.catalog",
        publish.catalog_snapshot(catalog.contract_table(spark), zones.read("ops.sla_status"), ctx),
    )
    critical = quality.summary(results).first()["critical_failures"]
    broken = counts.pop("ops.contract_problems")
    if enforce and critical:
        raise CriticalQualityFailure(f"{critical} critical rule(s) failed; see ops.dq_results")
    if enforce and broken:
        raise CriticalQualityFailure(f"{broken} contract problem(s); see ops.contract_problems")
    if waiting is not None:
        for step in GOLD:
            if waiting.exists(step.output):
                zones.take_over(step.output, waiting)
    return counts


def record_runs(zones: Zones, ctx: RunContext, counts: Mapping[str, int]) -> int:
    """One row per table written by a run, in ``ops.pipeline_runs``."""
    rows = [(ctx.job_run_id, name.split(".")[0], name, rows) for name, rows in counts.items()]
    frame = zones.spark.createDataFrame(rows, "job_run_id string, stage string, dataset string, row_count bigint")
    return zones.write("ops.pipeline_runs", ctx.stamped(frame, "run_ts"))


STAGES = ("bronze", "silver", "gold", "publish")


def run(
    zones: Zones, ctx: RunContext, landing: str, stages: Sequence[str] = STAGES, *, enforce: bool = True
) -> dict[str, int]:
    """The requested stages in their order; missing bronze tables are ingested first."""
    unknown = sorted(set(stages) - set(STAGES))
    if unknown:
        raise ValueError(f"unknown stage(s): {', '.join(unknown)}; valid: {', '.join(STAGES)}")
    counts: dict[str, int] = {}
    if "bronze" in stages or not zones.exists(CRM):
        counts |= ingest_bronze(zones, landing)
    if "silver" in stages:
        counts |= build_silver(zones, ctx)
    # A run that also publishes lets the products wait for the verdict.
    waiting = candidates(zones) if "publish" in stages else None
    if "gold" in stages:
        counts |= build_gold(zones, ctx, landing, into=waiting)
    if "publish" in stages:
        counts |= publish_all(zones, ctx, enforce=enforce, waiting=waiting if "gold" in stages else None)
    record_runs(zones, ctx, counts)
    return counts


def run_release(releases: Releases, ctx: RunContext, landing: str, *, enforce: bool = True) -> tuple[Release, dict[str, int]]:
    """A whole run in a folder of its own, which becomes the release that readers see only when all of it is there.

    A run that fails, or ends between any two steps, leaves the release before it untouched. SQL names are moved to the
    new release afterwards; they follow the pointer again whenever ``current().register_all()`` is called.
    """
    since, draft = releases.latest(), releases.draft()
    counts = run(draft, ctx, landing, enforce=enforce)
    release = releases.commit(draft, ctx.job_run_id, since)
    releases.current().register_all()
    return release, counts
