"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed hash. A source takes all documents whose hash lies below its threshold, so budgets are
nested: a larger budget keeps all that a smaller one took. The threshold comes from a histogram of words by (source,
leading hash bits): the bucket in which the running sum crosses the budget is refined by the next bits, on its own
rows only, until one hash value is left. Nothing is sorted, and a rerun takes the same documents.

Targets share ``factor`` times all words by weight; a target stops at ``most`` times the words of its source, and the
excess is shared again by weight among the others. A budget of more than the source is met by taking every document
once and the documents below the threshold twice. The document on the threshold is taken if that brings the sum
closer to the target. Documents without words change nothing and follow their hash.

Scale: sums are map-side combined, so a hot source costs one row per task and bucket; windows run over at most 4096
buckets of one source, or over one row per source. Rows of the boundary bucket shrink 4096-fold a level. The final
filter joins one row per source, broadcast only if there are few.

Nulls: a null text has size zero; a null source is a source of its own, last in order; a null id is hashed as an empty
one. Identical rows share their hash and are taken or left together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORD, store, with_small

BITS, LEVEL = 60, 12


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in code-point order, repeating.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words of the mix, and most words from a source, as multiples (halves are exact in double).
    factor: float = 1.5
    most: float = 2.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column, text: Column) -> Column:
    """A fixed 60-bit hash of the row."""
    seed = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``sizes``: (source, source_size), one row per source. Adds ``target``, and ``base`` and ``extra``: how often
    every document is taken, and the words still to take below the threshold."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(mix.weights))) + 1)
    weighted = sizes.withColumn("w", weight).withColumn("fill", F.lit(mix.most) * F.col("source_size") / F.col("w"))
    # Sources reach their limit in the order of ``fill``. With the first ones full, the rest divide what is left.
    full = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.lit(mix.most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing))
    shared = weighted.withColumn("level", (F.lit(mix.factor) * F.sum("source_size").over(everything.orderBy("fill")) - held) / rest)
    open_ = F.when(F.col("level") <= F.col("fill"), F.col("level"))
    levelled = shared.withColumn("level", F.max(open_).over(everything.orderBy("fill")))
    target = F.least(F.coalesce(F.col("w") * F.col("level"), F.lit(mix.most) * F.col("source_size")), F.lit(mix.most) * F.col("source_size"))
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(mix.most) - 1))).otherwise(0)
    return (
        levelled.withColumn("target", target)
        .withColumn("base", base.cast("long"))
        .withColumn("extra", F.col("target") - F.col("base") * F.col("source_size"))
        .select("source", "source_size", "target", "base", "extra")
    )


def thresholds(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``rows``: stored (source, size, h). One row per source: sizes, target, ``base`` and ``below``, the exclusive
    hash bound of what is taken once more."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = store(targets(sizes, mix), "mix-targets", 0)
    current = rows
    state = plan.select("source", F.col("extra").alias("left"))
    done: list[DataFrame] = []
    for level in range(1, BITS // LEVEL + 1):
        shift = BITS - level * LEVEL
        bucket = F.shiftright("h", shift)
        sums = current.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        summed = sums.withColumn("until", running).select(F.col("source").alias("s"), "bucket", "words", "until", "low", "high")
        crossing = summed.join(state, F.col("s").eqNullSafe(F.col("source"))).where((F.col("until") >= F.col("left")) & (F.col("until") - F.col("words") < F.col("left")))
        bound = store(crossing.select("source", "bucket", (F.col("left") - F.col("until") + F.col("words")).alias("left"), "words", "low", "high"), "mix-bound", 0)
        single = bound.where("low = high")
        done.append(single.select("source", (F.col("low") + (F.col("words") <= 2 * F.col("left")).cast("long")).alias("below")))
        wide = bound.where("low <> high")
        if wide.isEmpty():
            break
        state = wide.select("source", "left")
        edge = wide.select(F.col("source").alias("s"), F.col("bucket").alias("b"))
        here = with_small(current, edge, current["source"].eqNullSafe(F.col("s")) & (bucket == F.col("b")), "left_semi")
        current = store(here.select("source", "size", "h"), "mix-edge")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.select(F.col("source").alias("s"), "below")
    nothing = F.when(F.col("extra") > 0, F.lit(1 << BITS)).otherwise(0)
    placed = plan.join(found, plan["source"].eqNullSafe(found["s"]), "left")
    return store(placed.select("source", "source_size", "target", "base", F.coalesce("below", nothing).cast("long").alias("below")), "mix-thresholds", 0)


def copies() -> Column:
    """How often a row with ``h`` is taken, given the columns of :func:`thresholds`."""
    return F.col("base") + (F.col("h") < F.col("below")).cast("long")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: key, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words."""
    narrow = docs.select(
        docs[key].alias("id"), docs[source].alias("source"), words(docs[text]).alias("size"), place(docs[key], docs[text]).alias("h")
    )
    rows = store(narrow, "mix-rows")
    plan = thresholds(rows, mix).withColumnRenamed("source", "s")
    joined = with_small(rows, plan, rows["source"].eqNullSafe(plan["s"]), "left")
    return joined.select(
        F.col("id").alias(key), "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken")
    )


def take_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns unchanged; texts are not shuffled."""
    h = place(docs[key], docs[text]).alias("h")
    rows = store(docs.select(docs[source].alias("source"), words(docs[text]).alias("size"), h), "mix-rows")
    plan = thresholds(rows, mix).select(F.col("source").alias("s"), "base", "below")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    marked = docs.select(whole, docs[source].alias("source"), h)
    joined = with_small(marked, plan, marked["source"].eqNullSafe(plan["s"]))
    times = F.when(copies() > 0, F.sequence(F.lit(1), copies().cast("int")))
    return joined.select("doc", F.explode(times)).select("doc.*")
