"""Hard negatives by an inverted multi-index, exact.

A vector is cut in two halves and each half is quantised by its own codebook; a pair of codewords is a cell. For an
anchor ``q`` no vector of cell ``(i, j)`` scores more than ``q1.c1[i] + |q1| r1[i] + q2.c2[j] + |q2| r2[j]``, where ``r``
is the largest distance of a vector to its codeword over all rows; with a minus sign before the radii no vector scores
less. As the bound is a sum of one number per half, a heap over the two sorted lists visits the cells in falling order
of it (multi-sequence), and the search is certified as soon as the next bound is below the worst result held.

Steps. The codebooks are fitted on a bounded sample (``Miner.sample`` rows by hash); every row is indexed: cells are
packed, in order, into blocks of about ``Miner.block`` rows, and a cell with more rows is split over several blocks. A
search has two rounds: each anchor first visits its best cells until they hold ``Miner.probe`` rows, which gives it a
threshold; then it visits on, until the bound falls below that threshold. Positives are searched like this over rows of
the anchor's label, then negatives over the other rows, with one score window per positive; cells whose highest possible
score lies below every window, or whose lowest one lies above all, are never opened. Nothing is approximate: the sample
and the radii only decide how many cells are opened. Recall against brute force is 1 by construction, and the tests
compare whole results.

Scale. An anchor travels once to each block that holds a cell it visits. In a task a block comes first and the visits to
it stream past, so memory is one block, whatever the number of anchors or the size of a cell; results are cut to the
few rows wanted per visit before they are shuffled. What the driver sees: the sample, the radii and the sizes of cells,
all bounded by parameters (at most ``Miner.words`` codewords a half).

Defined results. Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows
whose vector has another length than most (ties: the greater length). A null id is never an anchor and comes last among
equal scores. Repeated rows count as rows of their own, except that equal anchors are one; a row never meets rows of its
own id. Equal scores go by the smaller id. No anchor, no positive or no window: no row. An empty table gives no row.
Texts play no part. Other columns, whatever their names, are not read. Scores must fit 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import store

LAST_ID = (1 << 63) - 1
FLOOR = -(1 << 62)


@dataclass(frozen=True)
class Miner:
    positives: int = 5
    negatives: int = 10
    #: A negative's score lies between these percentages of its positive's.
    low: int = 30
    high: int = 90
    #: Components become ``floor(scale * x)``.
    scale: int = 256
    anchor_every: int = 100
    #: Most codewords of a half; the number follows the rows, one cell for about ``cell`` rows.
    words: int = 256
    cell: int = 64
    sample: int = 8_192
    block: int = 4_096
    probe: int = 4_096


@dataclass(frozen=True)
class Index:
    """Codebooks, radii and the packed blocks."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    #: Per cell: rows, first block, number of blocks.
    sizes: np.ndarray
    first: np.ndarray
    spread: np.ndarray
    blocks: DataFrame


def participants(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, with integer components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    picked = rows.select(
        rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("long").alias("label"), rows["embedding"].cast("array<double>").alias("x")
    ).where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return picked.select("vec_id", "label", whole.alias("v"))


def matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Codewords of the rows of ``x``, from evenly spread starts; deterministic."""
    x = np.unique(x, axis=0).astype(np.float64)
    words = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = nearest(x, words)[0]
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row and the distance to it."""
    x = x.astype(np.float64)
    near = np.argmin((words**2).sum(1)[None, :] - 2 * (x @ words.T), axis=1)
    return near, np.sqrt(((x - words[near]) ** 2).sum(1))


def build_index(rows: DataFrame, count: int, dims: int, miner: Miner) -> Index:
    half, k = dims // 2, int(np.clip(np.sqrt(count / miner.cell), 1, miner.words))
    # Twice the sample is the bound, should equal rows be drawn together; results do not depend on it.
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, count // miner.sample))) == 0
    drawn = rows.where(share).select("v").limit(2 * miner.sample).toPandas()["v"]
    drawn = np.array(drawn.tolist(), np.int64).reshape(-1, dims)
    if not len(drawn):
        drawn = np.zeros((1, dims), np.int64)
    words = k_means(drawn[:, :half], k), k_means(drawn[:, half:], k)
    wide = len(words[1])

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                (c1, d1), (c2, d2) = nearest(x[:, :half], words[0]), nearest(x[:, half:], words[1])
                extra = [pa.array(a) for a in (c1 * wide + c2, c1, c2, d1, d2)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["vec_id", "label", "v", "cell", "c1", "c2", "d1", "d2"])

    shape = "vec_id long, label long, v array<long>, cell long, c1 long, c2 long, d1 double, d2 double"
    placed = store(rows.mapInArrow(coded, shape).withColumn("origin", F.monotonically_increasing_id()), "negatives-coded")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).toPandas()
    sizes = np.zeros(len(words[0]) * wide, np.int64)
    sizes[cells["cell"]] = cells["n"]
    radii = np.zeros(len(words[0])), np.zeros(wide)
    np.maximum.at(radii[0], cells["cell"] // wide, cells["d1"])
    np.maximum.at(radii[1], cells["cell"] % wide, cells["d2"])
    # Small neighbours share a block, a large cell gets several of its own.
    first, spread, block, held = np.zeros_like(sizes), np.ones_like(sizes), 0, 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > miner.block:
            block, held = block + 1, 0
        first[cell], spread[cell] = block, max(1, -(-n // miner.block))
        block, held = (block + int(spread[cell]), 0) if spread[cell] > 1 else (block, held + n)
    lists = [F.from_json(F.lit(str(a.tolist())), "array<bigint>") for a in (first, spread)]
    at = (F.col("cell") + 1).cast("int")
    own = F.element_at(lists[0], at) + F.pmod(F.xxhash64("origin"), F.element_at(lists[1], at))
    dealt = placed.select(own.alias("block"), "cell", "vec_id", "label", "v").repartition("block").sortWithinPartitions("block", "cell")
    return Index(words, radii, sizes, first, spread, store(dealt.mapInArrow(packed, BLOCK), "negatives-index"))


BLOCK = "block long, cells binary, edges binary, ids binary, labels binary, v binary"
BLOCK_NAMES = ["block", "cells", "edges", "ids", "labels", "v"]


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and cell to one row per block."""
    held: list[tuple] = []
    now = None

    def out() -> pa.RecordBatch:
        cell, ids, labels, v = (np.concatenate(x) for x in zip(*held))
        cells, edges = np.unique(cell, return_index=True)
        small = np.int32 if np.abs(v).max(initial=0) < 1 << 31 else np.int64
        parts = [a.astype(np.int64).tobytes() for a in (cells, np.append(edges, len(cell)), ids, labels)]
        return pa.RecordBatch.from_arrays([pa.array([now]), *[pa.array([p], pa.binary()) for p in (*parts, v.astype(small).tobytes())]], BLOCK_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        block, v = batch.column(0).to_numpy(), matrix(batch)
        cell, labels = batch.column(1).to_numpy(), batch.column(3).to_numpy()
        ids = batch.column(2).fill_null(LAST_ID).to_numpy()
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            if held and block[a] != now:
                yield out()
                held = []
            now = int(block[a])
            held.append((cell[a:b], ids[a:b], labels[a:b], v[a:b]))
    if held:
        yield out()


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) in falling order of the sum."""
    ra, rb = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    xa, xb = a[ra].tolist(), b[rb].tolist()
    heap, reached = [(-(xa[0] + xb[0]), 0, 0)], [-1] * len(xa)  # reached[i]: the last j of row i that left the heap
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, ra[i], rb[j]
        reached[i] = j
        # A pair enters the heap once both its predecessors have left it.
        if j + 1 < len(xb) and (i == 0 or reached[i - 1] >= j + 1):
            heapq.heappush(heap, (-(xa[i] + xb[j + 1]), i, j + 1))
        if i + 1 < len(xa) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (-(xa[i + 1] + xb[j]), i + 1, j))


def visited(index: Index, q: np.ndarray, most: int | None, skip: int, least: float, greatest: float) -> tuple[dict[int, list[int]], int, bool]:
    """Cells to open by block, the number of cells the heap has given so far, and whether the sequence is over.

    ``skip`` cells were visited before. With ``most`` it stops when the opened cells hold so many rows, and in any case
    when the bound falls below ``least``: then no cell left holds a score of ``least`` or more. Cells that only hold
    scores above ``greatest`` are passed by.
    """
    half, wide = index.words[0].shape[1], len(index.words[1])
    high, low = [], []
    for part, words, radii in zip((q[:half], q[half:]), index.words, index.radii):
        part = part.astype(np.float64)
        centre, slack = words @ part, np.sqrt(part @ part) * radii
        room = 1e-9 * (np.abs(words) @ np.abs(part) + slack) + 1e-6  # more than rounding can take away
        high.append(centre + slack + room)
        low.append(centre - slack - room)
    opened: dict[int, list[int]] = {}
    rows = given = 0
    for bound, i, j in multi_sequence(*high):
        if bound < least:
            return opened, given, True
        given += 1
        cell = i * wide + j
        n = int(index.sizes[cell])
        if given <= skip or not n or low[0][i] + low[1][j] > greatest:
            continue
        for k in range(int(index.spread[cell])):
            opened.setdefault(int(index.first[cell]) + k, []).append(cell)
        rows += n
        if most is not None and rows >= most:
            return opened, given, False
    return opened, given, True


VISIT = "block long, anchor long, vec_id long, label long, v array<long>, cells array<long>, places array<long>, floors array<long>, ceilings array<long>, given long, over boolean"
VISIT_NAMES = [f.split()[0] for f in VISIT.split(", ")]
VISIT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.int64(), pa.bool_()]


def visits(anchors: DataFrame, index: Index, most: int | None) -> DataFrame:
    """One row per anchor and block it visits. ``anchors``: anchor, vec_id, label, v, places, floors, ceilings, given.

    A window is a place (its number), a floor and a ceiling; the floor is where the search may stop.
    """
    light = Index(index.words, index.radii, index.sizes, index.first, index.spread, None)

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a in batch.to_pylist():
                found, given, over = visited(light, np.array(a["v"], np.int64), most, a["given"], min(a["floors"]), max(a["ceilings"]))
                own = [a[n] for n in ("anchor", "vec_id", "label", "v")]
                rows += [(b, *own, cells, a["places"], a["floors"], a["ceilings"], given, over) for b, cells in found.items()]
            columns = zip(*rows) if rows else [[]] * len(VISIT_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, VISIT_KINDS)], VISIT_NAMES)

    return anchors.mapInArrow(visit, VISIT)


#: Visits that share one copy of a block.
VISITS = 8_192
FOUND = "anchor long, place long, id long, score long"


def scored(index: Index, asked: DataFrame, keep: int, same_label: bool) -> DataFrame:
    """(anchor, place, id, score): per visit and window the best ``keep`` rows of the visited cells of one block."""
    # Many visits to a block are shared out among copies of it.
    copies = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITS).alias("copies"))
    blocks = index.blocks.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    block = blocks.select("block", "copy", F.lit(0).alias("kind"), F.struct(*BLOCK_NAMES[1:]).alias("b"), F.lit(None).cast(f"struct<{_struct(VISIT)}>").alias("q"))
    visit = asked.join(copies, "block").select(
        "block",
        F.pmod(F.xxhash64("anchor"), "copies").alias("copy"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(block.schema["b"].dataType).alias("b"),
        F.struct(*VISIT_NAMES).alias("q"),
    )
    both = block.unionByName(visit)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out: list[tuple] = []
            kinds = batch.column(2).to_pylist()
            blocks, queries = batch.column(3), batch.column(4)
            for at, kind in enumerate(kinds):
                if kind == 0:
                    now = Opened(blocks[at].as_py())
                else:
                    out += now.best(queries[at].as_py(), keep, same_label)
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["anchor", "place", "id", "score"])

    return both.repartition("block", "copy").sortWithinPartitions("block", "copy", "kind").mapInArrow(score, FOUND)


def _struct(ddl: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


class Opened:
    """A block in memory."""

    def __init__(self, row: dict) -> None:
        self.cells, self.edges, self.ids, self.labels = (np.frombuffer(row[n], np.int64) for n in ("cells", "edges", "ids", "labels"))
        self.raw, self.width = row["v"], len(row["v"]) // max(len(self.ids), 1)
        self.v: np.ndarray | None = None

    def rows(self, dims: int) -> np.ndarray:
        if self.v is None:
            found = np.frombuffer(self.raw, np.int32 if self.width == 4 * dims else np.int64).reshape(-1, dims)
            self.most = int(np.abs(found).max(initial=0))
            self.exact, self.v = found.astype(np.int64), found.astype(np.float64)
        return self.v

    def best(self, q: dict, keep: int, same_label: bool) -> list[tuple]:
        v = np.array(q["v"], np.int64)
        x = self.rows(len(v))
        picked = np.searchsorted(self.cells, q["cells"])
        picked = picked[(picked < len(self.cells)) & (self.cells[np.minimum(picked, len(self.cells) - 1)] == q["cells"])]
        if len(picked) == len(self.cells):
            at = np.arange(len(self.ids))
        else:
            at = np.concatenate([np.arange(self.edges[p], self.edges[p + 1]) for p in picked.tolist()] or [np.zeros(0, np.int64)])
        at = at[((self.labels[at] == q["label"]) == same_label) & (self.ids[at] != q["vec_id"])]
        # Doubles hold these sums exactly unless components are huge.
        if self.most * int(np.abs(v).max(initial=0)) * len(v) < 1 << 53:
            scores = (x[at] @ v.astype(np.float64)).astype(np.int64)
        else:
            scores = self.exact[at] @ v
        order = np.lexsort((self.ids[at], -scores))
        ids, scores = self.ids[at][order], scores[order]
        out = []
        for place, low, high in zip(q["places"], q["floors"], q["ceilings"]):
            begin, end = np.searchsorted(-scores, -high, "left"), np.searchsorted(-scores, -low, "right")
            out += [(q["anchor"], place, int(i), int(s)) for i, s in zip(ids[begin : min(end, begin + keep)], scores[begin : min(end, begin + keep)])]
        return out


def ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search(anchors: DataFrame, index: Index, miner: Miner, keep: int, same_label: bool, label: str) -> DataFrame:
    """The best ``keep`` rows per anchor and window (anchor, place, id, score, rank).

    ``anchors``: anchor, vec_id, label, v, places, floors, ceilings.
    """
    begun = anchors.withColumn("given", F.lit(0).cast("long"))
    asked = store(visits(begun, index, miner.probe), f"{label}-asked")
    first = store(ranked(scored(index, asked, keep, same_label), keep), f"{label}-first")
    # With ``keep`` results in hand nothing below the worst of them is wanted; equal scores are, for their ids.
    worst = first.where(F.col("rank") == keep).select("anchor", "place", F.col("score").alias("worst"))
    windows = anchors.select("anchor", F.explode(F.arrays_zip("places", "floors", "ceilings")).alias("w")).select("anchor", "w.*")
    raised = (
        windows.withColumnsRenamed({"places": "place", "floors": "floor", "ceilings": "ceiling"})
        .join(worst, ["anchor", "place"], "left")
        .groupBy("anchor")
        .agg(
            F.collect_list("place").alias("places"),
            F.collect_list(F.greatest("floor", "worst")).alias("floors"),
            F.collect_list("ceiling").alias("ceilings"),
        )
    )
    # An anchor whose probe opened no cell has no visit and starts again.
    state = asked.groupBy("anchor").agg(F.max("given").alias("given"), F.bool_or("over").alias("over"))
    again = (
        anchors.select("anchor", "vec_id", "label", "v")
        .join(raised, "anchor")
        .join(state, "anchor", "left")
        .where(~F.coalesce("over", F.lit(False)))
        .select("anchor", "vec_id", "label", "v", "places", "floors", "ceilings", F.coalesce("given", F.lit(0).cast("long")).alias("given"))
    )
    more = scored(index, store(visits(again, index, None), f"{label}-more"), keep, same_label)
    return store(ranked(first.select("anchor", "place", "id", "score").unionByName(more), keep), label)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, miner: Miner = Miner()) -> DataFrame:
    """For each anchor and positive the best negatives within its score window. ``rows``: vec_id, embedding, label."""
    spark = rows.sparkSession
    every = participants(rows, miner.scale)
    counted = every.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if counted is None or not counted["dims"]:
        return spark.createDataFrame([], RESULT)
    dims, count = counted["dims"], counted["count"]
    every = every.where(F.size("v") == dims)
    index = build_index(every, count, dims, miner)
    anchors = every.where(F.col("vec_id") % miner.anchor_every == 0).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = store(anchors, "negatives-anchors")
    if not anchors.limit(1).count():
        return spark.createDataFrame([], RESULT)
    number = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    whole = anchors.withColumns({"places": number(0), "floors": number(FLOOR), "ceilings": number(-FLOOR)})
    positives = search(whole, index, miner, miner.positives, True, "negatives-positives")
    pairs = positives.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive"), F.col("score").alias("reward"))
    # low% <= negative <= high% in whole numbers: the quotient towards the inside of the window.
    wide = F.col("reward").cast("decimal(20,0)")
    inside = pairs.withColumns({"floor": -_floored(-wide * miner.low), "ceiling": _floored(wide * miner.high)})
    windows = (
        inside.where("floor <= ceiling")
        .groupBy("anchor")
        .agg(*[F.collect_list(c).alias(f"{c}s") for c in ("place", "floor", "ceiling")])
    )
    negatives = search(anchors.join(windows, "anchor"), index, miner, miner.negatives, False, "negatives-found")
    named = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return (
        negatives.join(pairs, ["anchor", "place"])
        .join(anchors.select("anchor", "vec_id"), "anchor")
        .select(
            F.col("vec_id").alias("anchor_id"),
            named("positive").alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            named("id").alias("negative_id"),
            F.col("reward").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )


def _floored(x: Column) -> Column:
    """x / 100 rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
