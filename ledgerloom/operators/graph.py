"""Traversal of an edge table (lineage between datasets or entities)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialise, scratch_path

#: A frontier of at most this many nodes is sent to all tasks; a larger one is joined by a shuffle.
SMALL_FRONTIER = 50_000


def _sides(direction: str) -> tuple[str, str]:
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"direction must be upstream or downstream, not '{direction}'")
    return ("to_dataset", "from_dataset") if direction == "upstream" else ("from_dataset", "to_dataset")


def upstream_of(edges: DataFrame, dataset: str) -> DataFrame:
    return (
        edges.filter(F.col("to_dataset") == dataset)
        .select(F.col("from_dataset").alias("dataset"))
        .distinct()
        .orderBy("dataset")
    )


def downstream_of(edges: DataFrame, dataset: str) -> DataFrame:
    return (
        edges.filter(F.col("from_dataset") == dataset)
        .select(F.col("to_dataset").alias("dataset"))
        .distinct()
        .orderBy("dataset")
    )


def trace(edges: DataFrame, dataset: str, direction: str = "upstream", depth: int | None = None) -> DataFrame:
    """Every edge reachable from ``dataset``, with the level it is crossed at.

    Breadth first by joins until nothing new is reached (or down to ``depth`` levels, if a
    caller asks for that): the nodes first met in the last round meet the edge table, what
    they reach is kept, and the nodes not seen before form the next round. A node is
    expanded once, so cycles and diamonds end. Each round is written to the durable
    checkpoint folder: a round only reads earlier rounds from there, and a lost executor
    costs one round. While the frontier is small it is broadcast, so a round is a filter
    over the edges without moving them; as a semi-join it also passes below the distinct
    of edges that are derived from facts, to their scans.
    """
    near, far = _sides(direction)
    hops = edges.select(
        F.col(near).alias("node"), F.col(far).alias("dataset"), "transform_id"
    )
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(dataset).alias("node"))
    seen, size, level, found = frontier, 1, 0, None
    while found is None or (size and (depth is None or level < depth)):
        level += 1
        near_nodes = F.broadcast(frontier) if size <= SMALL_FRONTIER else frontier
        reached = materialise(
            hops.join(near_nodes, "node", "left_semi")
            .select("node", "dataset", "transform_id")
            .distinct()
            .select("dataset", "transform_id", F.lit(direction).alias("direction"), F.lit(level).alias("level"))
        )
        found = reached if found is None else found.unionByName(reached)
        nodes = reached.select(F.col("dataset").alias("node")).distinct()
        frontier = materialise(nodes.join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
        size = frontier.count()
    return found


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The distinct rows as a table in buckets of ``key`` and its name; joins on the key do not move it again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "buckets")
    count, name = int(spark.conf.get("spark.sql.shuffle.partitions")), path.rpartition("/")[2].replace("-", "_")
    dealt = df.repartition(count, key).distinct()
    dealt.write.bucketBy(count, key).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    return spark.table(name), name


def reach(edges: DataFrame, starts: DataFrame, direction: str = "upstream") -> DataFrame:
    """``(start, dataset)``: every node reached from each node of ``starts`` (``start``), in one traversal.

    Starts are numbered and 64 of them share one ``bits`` word, so a node carries one row for
    every 64 starts that reach it, and rows meet on (node, word) with ``bit_or``, map-side first.
    A round passes on only the bits that are new at a node, so cycles and diamonds end, and each
    round is written to the durable checkpoint folder. A start is in its own result only if a
    cycle leads back to it, as in ``trace``. Null starts and repeated starts count once or not
    at all; without starts or edges there is no row. Edges, repeated or not, move once: they are kept in buckets by their
    near node, and a round moves new bits only. The result, and so the work, grows with the
    pairs reached: ask from the side with fewer nodes.
    """
    near, far = _sides(direction)
    hops, table = bucketed(edges.select(F.col(near).alias("node"), F.col(far).alias("dataset")), "node")
    known = starts.select("start").where("start IS NOT NULL").distinct()
    numbered = materialise(known.withColumn("__id", F.monotonically_increasing_id()))
    asked = numbered.select(
        "start", F.floor(F.col("__id") / 64).alias("word"), F.expr("shiftleft(1L, CAST(__id % 64 AS INT))").alias("bit")
    )
    fresh = asked.groupBy(F.col("start").alias("node"), "word").agg(F.bit_or("bit").alias("bits"))
    seen = None
    while seen is None or not fresh.isEmpty():
        reached = (
            hops.join(fresh, "node").groupBy(F.col("dataset").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        )
        if seen is None:
            fresh = seen = materialise(reached)
            continue
        before = seen.withColumnRenamed("bits", "had")
        missing = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        fresh = materialise(
            reached.join(before, ["node", "word"], "left").select("node", "word", missing.alias("bits")).where("bits <> 0")
        )
        seen = materialise(seen.unionByName(fresh).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    edges.sparkSession.sql(f"DROP TABLE {table}")
    met = seen.join(asked, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return met.select("start", F.col("node").alias("dataset"))


def roots(traced: DataFrame, prefix: str = "bronze.") -> DataFrame:
    """The raw tables a trace ends in."""
    return traced.filter(F.col("dataset").startswith(prefix)).select("dataset").distinct().orderBy("dataset")
