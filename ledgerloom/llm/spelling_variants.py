"""Spelling variants: words one edit apart, found by dynamic programming over sorted word lists.

Two words are near if exactly one inserted, deleted or replaced code point separates them. A word's form is its near
word of largest count, if that count is ``Spelling.ratio`` times its own; its root is where the forms lead.

Method. In a sorted list the words that share a prefix stand together, and the lengths of the prefixes that neighbours
share (LCPs) mark these ranges. A query's edit matrix against a word needs three cells a row for one edit (a band), and
its rows depend on the word's prefix only: the rows of a shared prefix are computed once and reused for the whole range,
and a range whose row has no cell of at most one edit is skipped whole. All queries of a list advance together, one
letter of depth at a time, as arrays: a live (query, range) pair splits into the sub-ranges that the LCPs mark, or dies.

Partition. One list over all words would make every query meet the ranges of every first letter. One edit lies in the
first or in the second half of the shorter word, so near words share the other half: each word joins the lists of its
halves, as the shorter and as the longer word of a pair. A list with more than ``Spelling.most`` words is cut the same
way again, within the half that may differ, until the open part is one letter long, when a list cannot be large (at
most about 90 x 91 words). The rule that decides which list a pair belongs to is checked on the pair, so each pair is
found exactly once, and equal hashes of different halves do no harm.

Scale. Words are counted in the tasks before they are shuffled; lists are bounded as above, so neither a frequent word
nor a frequent prefix gathers in one task; the two aggregates over pairs combine map-side; forms are followed by pointer
jumping (counts grow by ``ratio`` a step, so few rounds), each round a written table. Nothing comes to the driver but
counts of rows.

Defined results. Null texts have no words, empty ones neither; a null id counts as empty in the damage rule. Very long
texts are counted like others, very long runs are words like others. Ties between near words go to the first in
code-point order. Repeated rows count again. An empty table gives no row. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ASCII_LOWER, raw, store, values

LETTERS = "a-zÀ-ÿ"
FAR = 9


@dataclass(frozen=True)
class Spelling:
    least_chars: int = 7
    least_count: int = 2
    ratio: int = 10
    #: Of runs whose CRC-32 of ``<doc_id>:<run>`` this divides, one letter is deleted (noise of a known place); 0: none.
    damage: int = 0
    #: Words of a list that is not cut further.
    most: int = 20_000
    #: Distinct words that a task counts before it hands them on.
    held: int = 200_000


def word_counts(docs: DataFrame, spelling: Spelling, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_chars`` letters and ``least_count`` occurrences."""
    run = re.compile(f"[{LETTERS}]{{{spelling.least_chars},}}")
    least, damage, held = spelling.least_chars, spelling.damage, spelling.held

    def packed(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, body in zip(values(batch, "id"), raw(batch, "text")):
                if body is None:
                    continue
                words = Counter(run.findall(body.translate(ASCII_LOWER).decode()))
                if damage:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in words.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        found[word] += n
                else:
                    found.update(words)
                if len(found) > held:
                    yield packed(found)
                    found.clear()
        yield packed(found)

    picked = docs.select(docs[key].cast("string").alias("id"), docs[text].alias("text"))
    counted = picked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return store(counted.where(F.col("n") >= spelling.least_count), "spelling-words")


def _listed(words: DataFrame, regions: Column) -> DataFrame:
    """A row per word and region: ``c`` letters of the shorter word, of which those from ``a`` to ``b`` may differ."""
    rows = words.select("word", "n", F.explode(regions).alias("r")).select("word", "n", "r.*")
    rest = F.col("c") - F.col("b")
    shared = [F.expr("substring(word, 1, a)"), F.when(rest > 0, F.expr("right(word, c - b)")).otherwise("")]
    return rows.withColumn("list", F.xxhash64("c", "a", "b", *shared))


def _region(c: Column, a: Column, b: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def lists(words: DataFrame, spelling: Spelling) -> Iterator[DataFrame]:
    """Tables of list members (list, word, n, c, a, b); no list but the smallest has more than ``most`` words."""
    size = F.length("word")

    def halves(c: Column) -> list[Column]:
        half = F.floor(c / 2)
        return [_region(c, half, c), _region(c, F.lit(0), half)]

    both = F.filter(F.array(*halves(size), *halves(size - 1)), lambda r: r["c"] >= spelling.least_chars)
    members = store(_listed(words, both), "spelling-lists")
    while True:
        cut = F.count_if(F.col("b") - F.col("a") > 1)
        large = members.groupBy("list").agg(F.count(F.lit(1)).alias("__n"), cut.alias("__cut")).where(f"__n > {spelling.most} AND __cut > 0")
        large = store(large.select("list"), "spelling-large")
        if not large.limit(1).count():
            yield members
            return
        yield members.join(large, "list", "left_anti")
        middle = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)
        inner = F.filter(
            F.array(_region(F.col("c"), middle, F.col("b")), _region(F.col("c"), F.col("a"), middle)), lambda r: r["b"] > r["a"]
        )
        rest = members.join(large, "list", "left_semi").withColumn("__inner", inner).drop("list", "c", "a", "b")
        members = store(_listed(rest, F.col("__inner")), "spelling-lists")


def near_words(members: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, each pair once."""

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        cells = 0

        def flush(whole: bool) -> pa.RecordBatch | None:
            """Pairs of the lists held; the last list may go on in the next batch, unless ``whole``."""
            nonlocal held, cells
            columns = [np.concatenate(x) for x in zip(*held)]
            keys = columns[0]
            other = np.flatnonzero(keys != keys[-1])
            end = len(keys) if whole else int(other[-1]) + 1 if len(other) else 0
            held = [tuple(c[end:] for c in columns)] if end < len(keys) else []
            cells = 0 if not held else int(held[0][6].sum())
            return paired(*(c[:end] for c in columns)) if end else None

        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.array(values(batch, "word"), object)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            numbers = [batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("list", "n", "c", "a", "b")]
            held.append((numbers[0], words, *numbers[1:], lengths))
            cells += int(lengths.sum())
            if cells > 400_000 and (out := flush(False)) is not None:
                yield out
        if held and (out := flush(True)) is not None:
            yield out

    sorted_lists = members.select("list", "word", "n", "c", "a", "b").repartition("list").sortWithinPartitions("list", "word")
    return sorted_lists.mapInArrow(near, "word string, near string, near_n long")


def paired(keys: np.ndarray, words: np.ndarray, n: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Near pairs within whole lists, sorted by list and word."""
    left, right = one_edit(keys, words, lengths)
    keep = [
        k
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist()))
        if c[i] == c[j] == min(lengths[i], lengths[j]) and a[i] == a[j] and b[i] == b[j] and _belongs(words[i], words[j], int(c[i]), int(a[i]), int(b[i]))
    ]
    left, right = left[keep], right[keep]
    one, two = np.concatenate([left, right]), np.concatenate([right, left])
    return pa.RecordBatch.from_arrays(
        [pa.array(words[one].tolist(), pa.string()), pa.array(words[two].tolist(), pa.string()), pa.array(n[two], pa.int64())], ["word", "near", "near_n"]
    )


def _belongs(u: str, v: str, c: int, a: int, b: int) -> bool:
    """The pair is in region (a, b): both sides shared, and the prefix up to ``b`` is not, or a later region had it."""
    tail = c - b
    return u[:a] == v[:a] and (not tail or (u[-tail:] == v[-tail:] and u[:b] != v[:b]))


def one_edit(keys: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i before j, of words one edit apart with the same key; sorted by key and word."""
    count, width = len(words), int(lengths.max(initial=0))
    text = np.zeros((count, width + 3), np.uint8)  # these letters are one byte each in Latin-1
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    text[np.arange(width + 3)[None, :] < lengths[:, None]] = flat
    # LCP of each word with the one before; -1 where a list begins.
    lcp = np.full(count, -1, np.int64)
    if count > 1:
        differ = text[1:, :width] != text[:-1, :width]
        lcp[1:] = np.where(keys[1:] == keys[:-1], np.where(differ.any(1), differ.argmax(1), width), -1)
    ends = np.append(np.flatnonzero(lcp < 0)[1:], count)
    stop = np.repeat(ends, np.diff(np.append(np.flatnonzero(lcp < 0), count)))
    q = np.flatnonzero(np.arange(count) + 1 < stop)
    low, high = q + 1, stop[q]
    rows = [np.full(len(q), x, np.int8) for x in (FAR, 0, 1)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(width + 1):
        if not len(q):
            break
        # Sub-ranges by the next letter: they begin where the LCP is no more than the depth.
        breaks = np.flatnonzero(lcp <= depth)
        first, last = np.searchsorted(breaks, low, "right"), np.searchsorted(breaks, high, "left")
        parts = last - first + 1
        owner = np.repeat(np.arange(len(q)), parts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[owner] + step
        begin = np.where(step == 0, low[owner], breaks[np.maximum(at - 1, 0)])
        finish = np.where(step == parts[owner] - 1, high[owner], breaks[np.minimum(at, len(breaks) - 1)])
        q, r0, r1, r2 = q[owner], *(r[owner] for r in rows)
        letter = text[begin, depth]
        # Words that end here: their distance stands in the cell of the query's length.
        done = np.flatnonzero(letter == 0)
        if len(done):
            cell = lengths[q[done]] - depth + 1
            value = np.select([cell == 0, cell == 1, cell == 2], [r0[done], r1[done], r2[done]], FAR)
            hit = done[value == 1]
            found.append((q[hit], begin[hit]))
        # The band of the next row: query letters before, at and after the diagonal.
        mine = text[q, depth - 1] if depth else np.zeros(len(q), np.uint8)
        n0 = np.minimum(r0 + (mine != letter), r1 + 1)
        n1 = np.minimum(np.minimum(r1 + (text[q, depth] != letter), r2 + 1), n0 + 1)
        n2 = np.minimum(r2 + (text[q, depth + 1] != letter), n1 + 1)
        live = np.flatnonzero((np.minimum(np.minimum(n0, n1), n2) <= 1) & (letter != 0))
        q, low, high = q[live], begin[live], finish[live]
        rows = [r[live].astype(np.int8) for r in (n0, n1, n2)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def spelling_variants(docs: DataFrame, spelling: Spelling = Spelling(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = word_counts(docs, spelling, key, text)
    best = None
    for members in lists(words, spelling):
        pairs = near_words(members)
        own = pairs.groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
        )
        own = store(own, "spelling-near")
        best = own if best is None else best.unionByName(own)
    best = best.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    joined = words.join(best, "word", "left")
    most = -F.col("best.less")
    fits = most >= F.col("n") * spelling.ratio
    formed = store(
        joined.select(
            "word",
            F.when(fits, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, most).alias("form_n"),
        ),
        "spelling-forms",
    )
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer jumping."""
    up = store(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while up.where("open").limit(1).count():
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = up.join(over, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
        )
        up = store(moved, "spelling-roots")
    return up.drop("open")
