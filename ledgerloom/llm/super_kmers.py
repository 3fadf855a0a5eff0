"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the least hash of its ``m``-word pieces, so equal windows have
equal minimisers. Consecutive windows with one minimiser (a super-k-mer) travel as one packed string to the bucket of
that minimiser, where sorting brings equal windows together exactly (words are numbered, sorted by a rolling hash and
compared word by word), and each window learns the smallest document it starts in.

What keeps this within its means at scale:

* Only minimisers that occur in two documents can hold a repeated window. A first narrow pass lists each document's
  minimisers; the shared ones are marked in a bitmap of fixed size, and the second pass packs only super-k-mers whose
  bit is set. A full bitmap costs traffic, never results.
* Equal packed strings collapse in a map-side combined aggregate before they reach a bucket, so a passage in a third
  of all documents is one row per task there.
* A minimiser with too many different strings (a common passage in ever new surroundings) is not sent to one task:
  its windows are spread by a 128-bit digest of their words and aggregated one by one.
* Texts of documents with something to remove are shuffled once; all others are finished in the first pass.

A document with a null id neither removes nor loses anything. Rows that repeat an id count as one document for the
comparison, and each row is cleaned by its own text. Null texts have no words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import raw, store, values


@dataclass(frozen=True)
class Kmers:
    k: int = 50
    m: int = 8
    #: Bits of the fixed bitmaps: 2**26 bits are 8 MB.
    bitmap_bits: int = 26
    #: A minimiser with more different strings, or bytes of them, is spread window by window.
    crowd_strings: int = 4096
    crowd_bytes: int = 16 << 20
    #: Words handled at once in a task.
    block_words: int = 400_000


PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every stretch of ``size`` numbers, by doubling."""
    with np.errstate(over="ignore"):
        power, width, level = PRIME, 1, ids.astype(np.uint64)
        out, done, rest = None, 0, size
        while True:
            if rest & 1:
                tail = level[done : len(level)] if done else level
                out = level if out is None else out[: len(tail)] * power + tail[: len(out)]
                done += width
            rest >>= 1
            if not rest:
                break
            level = level[:-width] * power + level[width:]
            power, width = power * power, width * 2
        return out[: max(0, len(ids) - size + 1)]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def super_kmers(docs: list[list[bytes]], shape: Kmers, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows, minimiser) of every run of windows with one minimiser."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(lengths.sum())
    if total < shape.k:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    numbers = np.fromiter((h for words in docs for h in map(hashes.__getitem__, words)), np.uint64, total)
    least = sliding_min(mixed(rolled(numbers, shape.m)), shape.k - shape.m + 1)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(docs)), lengths)[: len(least)]
    whole = np.arange(len(least)) + shape.k <= ends[owner]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(change & whole)
    stops = np.flatnonzero(np.append(change | ~whole, True))
    after = stops[np.searchsorted(stops, starts, side="right")]
    owner = owner[starts]
    return owner, starts - (ends - lengths)[owner], after - starts, least[starts]


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words of each text) in blocks of about ``size`` words; rows stay whole."""
    ids, docs, held = [], [], 0
    for batch in batches:
        for key, body in zip(values(batch, "id"), raw(batch, "text")):
            words = (body or b"").split()
            ids.append(key)
            docs.append(words)
            held += len(words)
            if held >= size:
                yield ids, docs
                ids, docs, held = [], [], 0
    if ids:
        yield ids, docs


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def window_leasts(packed: list[bytes], firsts: list[int], k: int) -> list[np.ndarray]:
    """For every window of every packed string the smallest ``first`` among the strings that hold an equal window."""
    number = defaultdict(count().__next__)
    parts = [np.fromiter(map(number.__getitem__, p.split()), np.int64) for p in packed]
    lengths = np.array([len(p) for p in parts])
    ids, ends = np.concatenate(parts), np.cumsum(lengths)
    per = lengths - k + 1
    at = np.concatenate([np.arange(e - n, e - k + 1) for e, n in zip(ends.tolist(), lengths.tolist())])
    owner = np.repeat(np.arange(len(parts)), per)
    order = np.argsort(rolled(mixed(ids.astype(np.uint64) + np.uint64(1)), k)[at], kind="stable")
    keys = rolled(mixed(ids.astype(np.uint64) + np.uint64(1)), k)[at][order]
    same = keys[1:] == keys[:-1]
    a, b = at[order][:-1][same], at[order][1:][same]
    for step in range(k):
        if not np.array_equal(ids[a + step], ids[b + step]):  # a hash collision: number the windows themselves
            exact = defaultdict(count().__next__)
            group = np.array([exact[ids[s : s + k].tobytes()] for s in at.tolist()])
            order = np.argsort(group, kind="stable")
            same = group[order][1:] == group[order][:-1]
            break
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    first = np.array(firsts, np.int64)[owner][order]
    least = np.minimum.reduceat(first, heads)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(at))))
    return np.split(out, np.cumsum(per)[:-1])


def bitmap(df: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of fixed size with the bits of a stored long column; the driver gets at most ``2**(bits - 6)`` words."""
    place = F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(place, 6).alias("word")
    ones = df.select(word, F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = ones.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("ones")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["ones"].to_numpy()
    return out.tobytes()


def marked(keys: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Which of the signed 64-bit keys have their bit set."""
    hashed = xxhash.xxh64_intdigest
    place = np.fromiter((hashed(x, 42) for x in keys.astype("<i8").view("V8").tolist()), np.uint64, len(keys))
    place = (place & np.uint64((1 << size) - 1)).astype(np.int64)
    return ((bits[place >> 6] >> (place & 63)) & 1).astype(bool)


def first_pass(docs: DataFrame, shape: Kmers) -> DataFrame:
    """(id, n_words, sha, minimisers) of every row."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for ids, texts in blocks(batches, shape.block_words):
            owner, _, _, least = super_kmers(texts, shape, hashes)
            edges = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([digest(t) for t in texts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(least.view(np.int64))),
                ],
                ["id", "n_words", "sha", "minimisers"],
            )

    return docs.mapInArrow(listed, "id long, n_words long, sha binary, minimisers array<long>")


def second_pass(docs: DataFrame, shape: Kmers, shared: bytes) -> DataFrame:
    """(v, id, sha, start, digest, packed) of the super-k-mers whose minimiser may be shared."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = WordHash(), np.frombuffer(sent.value, np.int64)
        for ids, texts in blocks(batches, shape.block_words):
            owner, start, windows, least = super_kmers(texts, shape, hashes)
            least = least.view(np.int64)
            hit = np.flatnonzero(marked(least, bits, shape.bitmap_bits))
            hit = hit[[ids[n] is not None for n in owner[hit].tolist()]] if len(hit) else hit
            if not len(hit):
                continue
            owner, start, windows, least = owner[hit], start[hit], windows[hit], least[hit]
            sha = {n: digest(texts[n]) for n in set(owner.tolist())}
            runs = zip(owner.tolist(), start.tolist(), windows.tolist())
            strings = [b" ".join(texts[n][s : s + w + shape.k - 1]) for n, s, w in runs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least),
                    pa.array([ids[n] for n in owner.tolist()], pa.int64()),
                    pa.array([sha[n] for n in owner.tolist()], pa.binary()),
                    pa.array(start),
                    pa.array([xxhash.xxh3_128_digest(s) for s in strings], pa.binary()),
                    pa.array(strings, pa.binary()),
                ],
                ["v", "id", "sha", "start", "digest", "packed"],
            )

    return docs.mapInArrow(packed, "v long, id long, sha binary, start long, digest binary, packed binary")


LEASTS = "v long, digest binary, leasts array<long>"


def bucket_leasts(strings: DataFrame, shape: Kmers) -> DataFrame:
    """Solve the buckets: ``strings`` (v, digest, packed, first) to (v, digest, leasts)."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        v, marks, packed, firsts = zip(*rows)
        leasts = window_leasts(list(packed), list(firsts), shape.k)
        edges = np.concatenate(([0], np.cumsum([len(x) for x in leasts]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(leasts)))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(marks, pa.binary()), lists], ["v", "digest", "leasts"])

    def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*(values(batch, c) for c in ("v", "digest", "packed", "first"))):
                if row[0] != last and held >= 8 * shape.block_words:  # bytes; buckets stay whole
                    yield solved(rows)
                    rows, held = [], 0
                last = row[0]
                rows.append(row)
                held += len(row[2])
        if rows:
            yield solved(rows)

    return strings.repartition("v").sortWithinPartitions("v").mapInArrow(buckets, LEASTS)


def crowded_leasts(strings: DataFrame, shape: Kmers) -> DataFrame:
    """The same for crowded minimisers, window by window."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(values(batch, c) for c in ("v", "digest", "packed", "first"))):
                words = row[2].split()
                n = len(words) - shape.k + 1
                marks = [xxhash.xxh3_128_digest(b" ".join(words[i : i + shape.k])) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row[0]] * n, pa.int64()),
                        pa.array([row[1]] * n, pa.binary()),
                        pa.array(range(n), pa.int64()),
                        pa.array(marks, pa.binary()),
                        pa.array([row[3]] * n, pa.int64()),
                    ],
                    ["v", "digest", "i", "mark", "first"],
                )

    windows = store(strings.mapInArrow(cut, "v long, digest binary, i long, mark binary, first long"), "kmer-windows")
    least = windows.groupBy("mark").agg(F.min("first").alias("least"))
    placed = windows.join(least, "mark").groupBy("v", "digest").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("all"))
    return placed.select("v", "digest", F.col("all.least").alias("leasts"))


def cleaned(docs: DataFrame, shape: Kmers, touched: DataFrame) -> DataFrame:
    """Apply ``touched`` (id, sha, runs of (start, leasts)) to the texts of those documents."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(touched, "id", shape.bitmap_bits))

    def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.int64)
        for batch in batches:
            ids = batch.column(0)
            hit = marked(ids.fill_null(0).to_numpy(zero_copy_only=False), bits, shape.bitmap_bits) & ids.is_valid().to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(hit))
            shas = [digest((body or b"").split()) for body in raw(some, "text")]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(shas, pa.binary()), some.column(1)], ["id", "sha", "text"])

    def removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, body, runs in zip(values(batch, "id"), raw(batch, "text"), values(batch, "runs")):
                words = body.split()
                steps = np.zeros(len(words) + 1, np.int64)
                for run in runs:
                    at = run["start"] + np.flatnonzero(np.array(run["leasts"]) < key)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + shape.k, -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((key, len(words), int(gone.sum()), b" ".join(kept)))
            columns = list(zip(*out)) if out else [()] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "n_words", "n_removed", "kept"])

    few = docs.mapInArrow(wanted, "id long, sha binary, text string")
    return few.join(touched, ["id", "sha"]).select("id", "text", "runs").mapInArrow(
        removed, "id long, n_words long, n_removed long, kept binary"
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Kmers = Kmers()) -> DataFrame:
    """One row per row of ``docs`` (integer key): key, ``n_words``, ``n_removed`` and ``kept_sha256``, the digest of
    the kept words joined by one space."""
    source = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    rows = store(first_pass(source, shape), "kmer-rows")
    seen = rows.where("id IS NOT NULL").select("id", F.explode("minimisers").alias("v"))
    shared = store(seen.groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("v"), "kmer-shared", seen.count())
    runs = store(second_pass(source, shape, bitmap(shared, "v", shape.bitmap_bits)), "kmer-runs")

    strings = store(runs.groupBy("v", "digest", "packed").agg(F.min("id").alias("first")), "kmer-strings")
    load = strings.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.length("packed")).alias("bytes"))
    crowd = store(load.where((F.col("n") > shape.crowd_strings) | (F.col("bytes") > shape.crowd_bytes)).select("v"), "kmer-crowd", strings.count())
    leasts = bucket_leasts(strings.join(crowd, "v", "left_anti"), shape)
    if not crowd.isEmpty():
        leasts = leasts.unionByName(crowded_leasts(strings.join(crowd, "v", "left_semi"), shape))

    places = runs.select("v", "digest", "id", "sha", "start").distinct()
    later = places.join(leasts, ["v", "digest"]).where(F.array_min("leasts") < F.col("id"))
    touched = store(later.groupBy("id", "sha").agg(F.collect_list(F.struct("start", "leasts")).alias("runs")), "kmer-touched")

    done = cleaned(source, shape, touched).select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    untouched = rows.join(touched.select("id", "sha"), ["id", "sha"], "left_anti")
    same = untouched.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"))
    return same.unionByName(done).withColumnRenamed("id", key)
