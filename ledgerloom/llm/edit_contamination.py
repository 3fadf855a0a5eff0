"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space becomes single spaces. A test item of ``n`` characters occurs in a
document if some stretch of the document is within ``floor(error_rate * n)`` edits of it. The item is split into one
piece more than that budget; ``k`` edits cannot touch all ``k + 1`` pieces, so one piece occurs exactly, near its place
in the stretch. An Aho-Corasick automaton finds all exact piece hits of a document in one pass; hits of one item on
neighbouring diagonals form a candidate, and Myers' bit-parallel distance over the window around it decides.

Scale: the test items are the stated query set. They are searched in blocks of bounded size (one pass over the
documents for each block); only a block's items travel to the tasks. Documents are never shuffled: the search is a
narrow stage, and dropping contaminated documents happens within it.

Items below ``min_chars`` normalised characters have no room for edits: they are one piece, and occur where that piece
stands between word boundaries (no letter or digit beside it).

Nulls and empty texts match nothing, nor do items that are empty once normalised. Repeated items and rows are reported
each. Very long texts are searched whole, in one pass. Of stretches with equal distance the first counts. Without items,
or without documents, there is no match. Other columns of the documents are carried by ``drop_contaminated`` whatever
their names, and not read by ``matches``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import values


@dataclass(frozen=True)
class Search:
    error_rate: float = 0.05
    min_chars: int = 32
    #: Characters of test items searched at once; bounds what travels to a task.
    block_chars: int = 8_000_000


#: The budget of an item too short for edits: whole words only.
EXACT = -1


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece): ``budget + 1`` pieces of nearly equal length that cover the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(least distance, end) of ``item`` against all stretches of ``text``; None if the distance exceeds the budget."""
    size = len(item)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, (size, 0)
    for at, c in enumerate(text):
        equal = peq.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        rise, fall = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += 1 if rise & top else -1 if fall & top else 0
        rise, fall = (rise << 1) & full, (fall << 1) & full
        plus, minus = fall | (full & ~(vertical | rise)), rise & vertical
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= budget else None


class Finder:
    """Piece automaton of one block of items."""

    def __init__(self, items: list[tuple[object, str]], search: Search) -> None:
        self.items = []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, body in items:
            if body:
                budget = int(search.error_rate * len(body)) if len(body) >= search.min_chars else EXACT
                for start, piece in pieces(body, max(budget, 0)):
                    where[piece].append((len(self.items), start))
                self.items.append((key, body, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if self.items:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item index, distance, end in the normalised text) of the best stretch of each item that occurs."""
        if not self.items:
            return
        diagonals: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for index, start in places:
                diagonals[index].add(end + 1 - size - start)
        for index, starts in diagonals.items():
            _, body, budget = self.items[index]
            if budget == EXACT:
                ends = (a + len(body) for a in sorted(starts))
                whole = (b for b in ends if not text[max(0, b - len(body) - 1) : b - len(body)].isalnum() and not text[b : b + 1].isalnum())
                if (end := next(whole, None)) is not None:
                    yield index, 0, end
                continue
            best, ordered = None, sorted(starts)
            first = last = ordered[0]
            for start in [*ordered[1:], None]:
                if start is not None and start - last <= 2 * budget:
                    last = start
                    continue
                left = max(0, first - budget)
                found = myers(body, text[left : last + len(body) + budget], budget)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], left + found[1])
                first = last = start
            if best:
                yield index, *best


def blocks(benchmark: DataFrame, key: str, text: str, search: Search) -> Iterator[list[tuple[object, str]]]:
    """The normalised items in blocks; the number of blocks follows from the size of the benchmark."""
    picked = benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    total = picked.agg(F.sum(F.length("t"))).first()[0] or 0
    number = 1 + total // search.block_chars
    for block in range(number):
        rows = picked.where(F.pmod(F.xxhash64("t"), F.lit(number)) == block).collect()
        yield [(r["k"], normal(r["t"])) for r in rows]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    search: Search = Search(),
) -> DataFrame:
    """One row per document row and item that occurs in it: key, item key, ``distance``, ``matched_end`` (in the
    normalised text) and ``item_chars``. Clean documents give no row."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType
    picked = docs.where(docs[text].isNotNull()).select(docs[key].alias("id"), docs[text].alias("text"))
    out = None
    for items in blocks(benchmark, item_key, item_text, search):

        def searched(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, search)
            for batch in batches:
                rows, at = [], []
                for n, body in enumerate(values(batch, "text")):
                    for index, distance, end in finder.find(normal(body)):
                        item, chars, _ = finder.items[index]
                        at.append(n)
                        rows.append((item, distance, end, len(chars)))
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                    [key, item_key, "distance", "matched_end", "item_chars"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(item_kind), pa.int64(), pa.int64(), pa.int64()]
        schema = f"`{key}` {kind}, `{item_key}` {item_kind.simpleString()}, distance long, matched_end long, item_chars long"
        part = picked.mapInArrow(searched, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", search: Search = Search()
) -> DataFrame:
    """The rows of ``docs`` in which no test item occurs, all columns unchanged; one narrow stage per block."""
    at = docs.columns.index(text)
    out = docs
    numbered = benchmark.select(F.lit(0).alias("k"), benchmark[item_text].alias("t"))
    for items in blocks(numbered, "k", "t", search):

        def clean(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, search)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                free = [t is None or next(finder.find(normal(t)), None) is None for t in texts]
                yield batch.filter(pa.array(free, pa.bool_()))

        out = out.mapInArrow(clean, out.schema)
    return out


