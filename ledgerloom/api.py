"""The names a user of the platform works with, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.audit import append_answers, drop_expired, latest_answer, recent_answers
from ledgerloom.operators.evaluation import failures as score_cases
from ledgerloom.operators.evaluation import gate
from ledgerloom.operators.graph import downstream_of, roots, upstream_of
from ledgerloom.operators.graph import trace as trace_lineage
from ledgerloom.operators.policy import check_use
from ledgerloom.operators.quality import evaluate as evaluate_rules
from ledgerloom.operators.search import resolve_terms, search_products
from ledgerloom.plans import metric_query as _metrics
from ledgerloom.plans.increment import LaidOut, run_increment
from ledgerloom.plans.medallion import build_gold, build_silver, ingest_bronze, run, run_release
from ledgerloom.plans.medallion import publish_all as publish
from ledgerloom.plans.metric_query import Filter, MetricRequest, TimeWindow, metric_query, preview
from ledgerloom.plans.publish import list_products, quality_summary
from ledgerloom.sources.differences import differing_keys, keep_delivery
from ledgerloom.sources.manifest import fingerprint
from ledgerloom.sources.releases import Releases
from ledgerloom.sources.zones import Zones

__all__ = [
    "Filter", "LaidOut", "MetricRequest", "Releases", "TimeWindow", "append_answers", "ask", "build_gold", "build_silver", "check_use",
    "differing_keys", "downstream_of", "drop_expired", "evaluate_rules", "fingerprint", "gate", "ingest_bronze", "keep_delivery", "latest_answer", "lineage_of",
    "list_products", "metric_query", "preview", "publish", "quality_summary", "recent_answers", "resolve_terms", "run", "run_increment", "run_release",
    "score_cases", "search_products", "sla", "trace_lineage", "upstream_of", "upstream_sources",
]


def ask(zones: Zones, request: MetricRequest) -> DataFrame:
    """A metric request against the published product it names."""
    planned = _metrics.plan(request)
    return _metrics.run(planned, zones.read(planned.contract.dataset))


def sla(zones: Zones, product: str | None = None) -> DataFrame:
    status = zones.read("ops.sla_status")
    return status if product is None else status.filter(F.col("product") == product)


def lineage_of(zones: Zones, product: str, direction: str = "upstream") -> DataFrame:
    dataset = product if "." in product else f"gold.{product}"
    return trace_lineage(zones.read("ops.lineage_edges"), dataset, direction)


def upstream_sources(zones: Zones, product: str) -> DataFrame:
    """The raw tables that ultimately feed a product."""
    return roots(lineage_of(zones, product))
