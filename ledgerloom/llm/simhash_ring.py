"""Near-duplicate classes by SimHash, with pigeonring filtering.

The 64 bits are laid out as a ring of ``m`` segments. If two fingerprints differ in at most ``t`` bits, some segment
starts a chain along the ring whose first ``l`` segments differ in at most ``floor(l * t / m)`` bits, for every
``l`` up to ``m``. While that budget is zero the chain must be equal, so those first segments are the join key; the
further budgets are tested as masks on the XOR, and only survivors reach the full Hamming test.

Scale: exact copies collapse to one row per fingerprint before anything is joined. A key shared by more than
``bucket`` fingerprints is not joined with itself: its fingerprints are expanded into the Hamming balls of radius
1 around them: two fingerprints within two bits share a point of those balls, and members of one point are within
two bits. A point has at most 65 members, so that way is linear and has no hot group whatever the data are.

One fingerprint within two bits is a strict test, so a caller may ask for several independent ones (``prints``); texts
are then linked if any of them is that close. All of them come from the same shingle hashes.

A null text counts as empty, and an empty text has fingerprint zero, linked like any other. Repeated rows share a
class. A null id never becomes a class id unless the class has nothing else (then the class id is null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ASCII_LOWER, raw, store
from ledgerloom.llm.components import components
from ledgerloom.llm.super_kmers import PRIME, mixed

BITS = 64


@dataclass(frozen=True)
class Ring:
    shingle: int = 3
    distance: int = 2
    segments: int = 5
    #: Keys with more fingerprints than this take the linear way.
    bucket: int = 512
    #: Independent fingerprints of a text; the first is the plain one.
    prints: int = 1

    def __post_init__(self) -> None:
        if self.distance not in (1, 2) or self.segments <= self.distance:
            raise ValueError("distance must be 1 or 2, with more segments than that")

    def masks(self, start: int) -> list[int]:
        """Masks of the chains of 1, 2, ... segments that begin at ``start``."""
        edges = [BITS * i // self.segments for i in range(self.segments + 1)]
        ones = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(self.segments)]
        chain, out = 0, []
        for step in range(self.segments):
            chain |= ones[(start + step) % self.segments]
            out.append(chain)
        return out

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    @property
    def equal_segments(self) -> int:
        return max(n for n in range(1, self.segments + 1) if self.budget(n) == 0)


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def fingerprint(text: bytes, size: int, prints: int = 1) -> list[int]:
    """Bits set in more than half of the shingle hashes; for further prints the hashes are mixed anew."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return [0] * prints
    line = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashed = xxhash.xxh64_intdigest
        spans = zip(starts.tolist(), ends[size - 1 :].tolist())
        hashes = np.fromiter((hashed(line[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)
    out = []
    for n in range(prints):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
            block = hashes[at : at + (1 << 16)]
            block = mixed(block ^ np.uint64(n * int(PRIME) % (1 << 64))) if n else block
            ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", ring: Ring = Ring()) -> DataFrame:
    """One row per row of ``docs``: the key and its fingerprints as signed longs."""

    def computed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[signed(p) for p in fingerprint(body or b"", ring.shingle, ring.prints)] for body in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], [key, "fps"])

    picked = docs.select(docs[key], docs[text].alias("text"))
    return picked.mapInArrow(computed, f"`{key}` {docs.schema[key].dataType.simpleString()}, fps array<long>")


def near_links(prints: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """``prints``: stored distinct (k, fp). Links ``(k, a, b)`` that connect all fingerprints of the same number ``k``
    within ``ring.distance`` bits.

    Keys below the bucket limit give every pair within the distance; larger ones give, for each shared ball point,
    links to its smallest member, which connect the same classes.
    """
    lead, on = ring.equal_segments, ["k", "s", "key"]
    starts = [
        F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(signed(ring.masks(s)[lead - 1]))).alias("key"))
        for s in range(ring.segments)
    ]
    keyed = prints.select("k", "fp", F.inline(F.array(*starts)))
    sizes = keyed.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    keyed = store(keyed.join(sizes, on), "simhash-keys", ring.segments * prints.count())  # a lone key has no pair
    small = keyed.where(F.col("n") <= ring.bucket)
    x = F.col("a").bitwiseXOR(F.col("b"))

    def chain(start: int) -> Column:
        masks = ring.masks(start)
        tests = [F.bit_count(x.bitwiseAND(F.lit(signed(masks[n - 1])))) <= ring.budget(n) for n in range(lead + 1, ring.segments)]
        whole = F.bit_count(x) <= ring.distance
        for test in reversed(tests):
            whole = test & whole
        return whole

    ringed = F.lit(False)
    for s in range(ring.segments):
        ringed = ringed | ((F.col("s") == s) & chain(s))
    pairs = small.select(*on, F.col("fp").alias("a")).join(small.select(*on, F.col("fp").alias("b")), on)
    links = pairs.where("a < b").where(ringed).select("k", "a", "b")

    crowded = keyed.where(F.col("n") > ring.bucket).select("k", "fp").distinct()
    ball = F.array(*[F.lit(0 if i < 0 else signed(1 << i)) for i in range(-1, BITS)])
    points = crowded.select("k", "fp", F.explode(ball).alias("flip"))
    points = points.select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("k", "point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    if ring.distance == 1:  # only the middle of a ball is within one bit of its members
        met = met.where(F.array_contains("all", F.col("point"))).select("k", F.col("point").alias("a"), "all")
    spread = met.select("k", "a", F.explode("all").alias("b")).where("a <> b")
    return links.unionByName(spread.select("k", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", ring: Ring = Ring()) -> DataFrame:
    """One row per row of ``docs``: key, ``fp`` (the first fingerprint) and ``component_id`` (smallest key of the class).

    Rows with the same fingerprints are one vertex; with a single fingerprint the vertex is named by it, with several
    by a 64-bit hash of them.
    """
    vertex = F.xxhash64("fps") if ring.prints > 1 else F.col("fps")[0]
    prints = store(fingerprints(docs, key, text, ring).withColumn("v", vertex), "simhash-fp")
    total = prints.count()
    groups = store(prints.groupBy("v", "fps").agg(F.min(key).alias("first")), "simhash-distinct", total)
    each = groups.select("v", F.posexplode("fps").alias("k", "fp"))
    met = store(each.groupBy("k", "fp").agg(F.min("v").alias("v"), F.count("*").alias("n")), "simhash-prints", total * ring.prints)

    def named(side: str, name: str) -> DataFrame:
        return met.select("k", F.col("fp").alias(side), F.col("v").alias(name))

    near = near_links(met.select("k", "fp"), ring).join(named("a", "va"), ["k", "a"]).join(named("b", "vb"), ["k", "b"])
    links = near.select(F.col("va").alias("a"), F.col("vb").alias("b"))
    if ring.prints > 1:  # different texts that share one of their fingerprints
        shared = each.withColumnRenamed("v", "a").join(met.where("n > 1").select("k", "fp", F.col("v").alias("b")), ["k", "fp"])
        links = links.unionByName(shared.where("a <> b").select("a", "b")).distinct()
    roots = components(links, "simhash-cc", total)
    placed = groups.join(roots.withColumnRenamed("id", "v"), "v", "left").select("v", "first", F.coalesce("root", "v").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_vertex = store(placed.join(smallest, "root").select("v", "component_id"), "simhash-classes", total)
    return prints.join(by_vertex, "v").select(key, F.col("fps")[0].alias("fp"), "component_id")


def drop_near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    ring: Ring = Ring(),
    classify: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """One row of each class stays: the one with the smallest key (of repeated keys, the one with the smallest text hash).
    ``classify`` gives other classes than those of ``ring``.

    Survivors are found on narrow rows. Texts move once, on (key, text hash), which has no hot values, and repeated
    rows are dropped in the same partitioning.
    """
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    name = F.coalesce(docs[key].cast("string"), F.lit("")).alias("k")
    tagged = docs.select(whole, name, F.xxhash64(docs[text]).alias("h"), docs[key].isNull().alias("lone"))
    row = F.struct("lone", F.col("doc")[key].alias("id"), "k", "h").alias("row")
    picked = tagged.select(row, F.col("doc")[text].alias("text"))
    placed = classify(picked, "row", "text") if classify else classes(picked, "row", "text", ring)
    stay = placed.select("component_id.k", "component_id.h").distinct()
    kept = tagged.join(stay, ["k", "h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("k", "h").orderBy("lone"))
    return kept.withColumn("n", first).where("n = 1").select("doc.*")
