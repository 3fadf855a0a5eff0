"""Connected components of a link table, by hooking and contraction in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import store


def components(links: DataFrame, label: str = "components", bound: int | None = None) -> DataFrame:
    """``links`` has long columns ``a`` and ``b``; returns one row ``(id, root)`` per linked id.

    Each round points every id at the smallest id of its neighbourhood, follows that pointer once more, and rewrites
    the links between what is left; links inside one tree vanish, so the table shrinks by a factor each round. Every
    step is a map-side combined aggregate or an equi-join with one row per id on one side (AQE can split a hub), and
    every round is a written table. The root is the smallest id reached through these pointers, not always the
    smallest id of the component; callers aggregate over it. Self-links and repeated links do no harm. ``bound`` is
    the expected number of links, if known.
    """
    rest = store(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), label, bound)
    rounds: list[DataFrame] = []
    while size := rest.count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), label, 2 * size)
        top = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        up = store(up.join(top, "p").select("a", F.col("pp").alias("p")), label, 2 * size)
        rounds.append(up)
        left = up.select("a", F.col("p").alias("x"))
        right = up.select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = rest.join(left, "a").join(right, "b").where("x <> y")
        rest = store(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), label, size)
    if not rounds:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("root"))
    final = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = final.select(F.col("a").alias("p"), F.col("p").alias("r"))
        final = earlier.join(later, "p", "left").select("a", F.coalesce("r", "p").alias("p"))
    return final.select(F.col("a").alias("id"), F.col("p").alias("root"))
