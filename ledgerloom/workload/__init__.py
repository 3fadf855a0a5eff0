"""The library's operators applied to the given tables."""

from ledgerloom.workload import answers, conformation, deliveries, gold, patterns, semantic, trust  # noqa: F401  (registration)
from ledgerloom.workload.registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
