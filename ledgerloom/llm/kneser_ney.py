"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, every run of other characters than letters becomes one space, and the ``order``-grams of the
characters are counted over all training texts: in the tasks first, then map-side combined in Spark. Lower orders use
continuation counts (in how many different contexts a shorter gram occurs), each order has its own absolute discount,
and what the discount saves is spread by the next shorter order. Probabilities and back-off weights are computed by Spark
and written as sorted hash arrays: for every order one table of grams and one of contexts, over all languages, cut into
shards by the leading bits of the hash. A text gets the language of the lowest cross-entropy per character. Rejection is calibrated: a text is ``rejected`` if even its best
cross-entropy is above what nearly all training texts of that language reached; every training row counts.

Size: every language and every gram is kept. Shards have about ``shard_entries`` entries, however large the model is;
a worker keeps the shards it last used, up to ``held_entries`` entries, and reads the others again when it needs them.
It handles about ``block_chars`` characters at once, fewer if there are many languages (``cells``), and looks every
distinct gram of a block up once, shard by shard. The driver knows the names of the languages and the number of shards.

A null or letterless text is ``und`` with score 0. Without any training text everything is ``und``; an empty table gives
an empty result. Texts longer than a block are read whole, in slices that each begin like a text. Repeated rows count as
often as they occur. Of equally cheap languages the first by name is taken. Columns are taken from the given frame by
its own names, so extra columns may be called anything. A null key is kept and never held out.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SharedFile, drop, filesystem, held_out, shared_folder, store, values, with_small


@dataclass(frozen=True)
class Shape:
    order: int = 4
    #: Entries of a shard of the model, about.
    shard_entries: int = 1_000_000
    #: Entries (20 bytes each) that a worker keeps at hand.
    held_entries: int = 6_000_000
    block_chars: int = 1_000_000
    #: Characters times languages that are scored at once.
    cells: int = 8_000_000
    #: Grams that a task gathers before it hands them on.
    task_grams: int = 2_000_000
    #: The share of the training texts of a language that must not be rejected.
    accept: float = 0.999
    #: Characters beyond which more text does not sharpen the score.
    evidence: int = 60


SPACE = 32
LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once in a process."""
    if not LETTERS:
        LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return LETTERS[0]


def folded(hashes: np.ndarray | None, column: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = column.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        if hashes is not None:
            h ^= hashes
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(31))


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = None
    for column in columns:
        h = folded(h, column)
    return h


def slices(texts: Iterable[str | None], size: int) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) in blocks of about ``size`` characters; longer texts in slices."""
    rows, block, held = [], [], 0
    for n, text in enumerate(texts):
        body = (text or "").lower()
        for at in range(0, max(1, len(body)), size):
            piece = body[at : at + size]
            if held + len(piece) > size and block:
                yield rows, block
                rows, block, held = [], [], 0
            rows.append(n)
            block.append(piece)
            held += len(piece)
    if block:
        yield rows, block


def characters(block: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(text number, columns): for every character kept, itself and the ``order - 1`` before it, oldest first."""
    points = np.frombuffer("".join(block).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(block)), np.fromiter(map(len, block), np.int64, len(block)))
    inked = letters()[points]
    keep = inked.copy()
    keep[1:] |= inked[:-1] & (owner[1:] == owner[:-1])  # the first space after a word
    owner, points = owner[keep], np.where(inked, points, SPACE)[keep]
    columns = [points]
    for back in range(1, order):
        shifted = np.full(len(points), SPACE, points.dtype)
        same = owner[back:] == owner[:-back]
        shifted[back:][same] = points[:-back][same]
        columns.insert(0, shifted)
    return owner, columns


def gram_counts(docs: DataFrame, shape: Shape) -> DataFrame:
    """(lang, gram, c) over all rows (lang, text)."""

    def compact(parts: list[tuple]) -> list[tuple]:
        langs, points, counts = (np.concatenate(x) for x in zip(*parts))
        _, first, where = np.unique(gram_hash([langs, *points.T]), return_index=True, return_inverse=True)
        return [(langs[first], points[first], np.bincount(where, weights=counts).astype(np.int64))]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, names = [], 0, {}

        def out() -> pa.RecordBatch:
            langs, points, counts = compact(parts)[0]
            body = np.ascontiguousarray(points.astype("<u4")).tobytes().decode("utf-32-le")
            grams = [body[i : i + shape.order] for i in range(0, len(body), shape.order)]
            spelled = list(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([spelled[i] for i in langs.tolist()]), pa.array(grams), pa.array(counts)], ["lang", "gram", "c"]
            )

        for batch in batches:
            tags = values(batch, "lang")
            for rows, block in slices(values(batch, "text"), shape.block_chars):
                owner, columns = characters(block, shape.order)
                if not len(owner):
                    continue
                lang = np.array([names.setdefault(tags[n], len(names)) for n in rows], np.int64)[owner]
                parts += compact([(lang, np.stack(columns, 1), np.ones(len(lang), np.int64))])
                held += len(parts[-1][0])
                if held > shape.task_grams:
                    parts = compact(parts)
                    held = len(parts[0][0])
                    if held > shape.task_grams // 2:
                        yield out()
                        parts, held, names = [], 0, {}
        if parts:
            yield out()

    partial = docs.select("lang", "text").mapInArrow(counted, "lang string, gram string, c long")
    return partial.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


#: Shards that this worker has read, the last used at the end.
SHARDS: OrderedDict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = OrderedDict()
EMPTY = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0))


@dataclass(frozen=True)
class Model:
    """Where the arrays are. Part ``2 n`` holds the grams of ``n + 1`` characters, part ``2 n + 1`` their contexts."""

    names: tuple[str, ...]
    order: int = 0
    folder: str = ""
    #: Leading hash bits that number the shards, by part.
    bits: tuple[int, ...] = ()
    #: Parts and shards that have entries.
    filled: frozenset[tuple[int, int]] = frozenset()
    uniform: float = 1e-5
    held_entries: int = 0

    @property
    def languages(self) -> dict[str, Language]:
        return {name: Language(self, n) for n, name in enumerate(self.names)}

    def shard(self, part: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes with the language and the value of each entry."""
        if (part, number) not in self.filled:
            return EMPTY
        path = f"{self.folder}/{part}-{number}"
        if path in SHARDS:
            SHARDS.move_to_end(path)
            return SHARDS[path]
        fs, local = filesystem(path)
        with fs.open_input_file(local) as file:
            data = file.read()
        count = len(data) // 20
        found = (
            np.frombuffer(data, "<u8", count),
            np.frombuffer(data, "<i4", count, 16 * count),
            np.frombuffer(data, "<f8", count, 8 * count),
        )
        while SHARDS and count + sum(len(s[0]) for s in SHARDS.values()) > self.held_entries:
            SHARDS.popitem(last=False)
        SHARDS[path] = found
        return found

    def entries(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``keys``, language, value) of all entries under these hashes."""
        numbers = shard_of(keys, self.bits[part])
        by = np.argsort(numbers, kind="stable")
        present, begin = np.unique(numbers[by], return_index=True)
        out = []
        for number, at in zip(present.tolist(), np.split(by, begin[1:])):
            hashes, langs, held = self.shard(part, number)
            first = np.searchsorted(hashes, keys[at])
            size = np.searchsorted(hashes, keys[at], "right") - first
            index = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            out.append((np.repeat(at, size), langs[index], held[index]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last column after the earlier ones, by row and language."""
        n = len(columns)
        if n == 1:
            p, contexts = np.full((len(columns[0]), len(self.names)), self.uniform), np.zeros(len(columns[0]), np.uint64)
        else:
            _, first, where = np.unique(gram_hash(columns[1:]), return_index=True, return_inverse=True)
            p, contexts = self.probabilities([c[first] for c in columns[1:]])[where], gram_hash(columns[:-1])
        distinct, where = np.unique(contexts, return_inverse=True)
        weights = np.ones((len(distinct), len(self.names)))
        row, lang, value = self.entries(2 * n - 1, distinct)
        weights[row, lang] = value
        p *= weights[where]
        row, lang, value = self.entries(2 * n - 2, gram_hash(columns))
        p[row, lang] = value
        return p


@dataclass(frozen=True)
class Language:
    """One language of a model."""

    model: Model
    place: int

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        return self.model.probabilities(columns)[:, self.place]


def shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def order_tables(counts: DataFrame, shape: Shape) -> list[DataFrame]:
    """(lang, gram, c) of the orders 1 to ``order``; shorter grams have continuation counts."""
    tables = [store(counts, "kn-counts")]
    for _ in range(shape.order - 1):
        shorter = tables[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        tables.insert(0, store(shorter, "kn-counts", tables[0].count()))
    return tables


def smoothed(tables: list[DataFrame], uniform: float) -> list[DataFrame]:
    """(lang, gram, value) by part: probabilities of the grams, back-off weights of the contexts, order after order."""
    out: list[DataFrame] = []
    for n, table in enumerate(tables, 1):
        rows = table.count()
        once = table.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        once = store(once.select("lang", discount.alias("d")), "kn-discounts", 1)
        split = table.withColumn("context", F.expr(f"substring(gram, 1, {n - 1})"))
        met = split.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        met = with_small(met.alias("m"), once.alias("d"), F.expr("m.lang = d.lang")).select(
            "m.lang", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("weight")
        )
        met = store(met, "kn-contexts", rows)
        grams = split.join(met, ["lang", "context"])
        if n == 1:
            lower = grams.withColumn("lower", F.lit(uniform))
        else:
            shorter = out[-2].select("lang", F.col("gram").alias("rest"), F.col("value").alias("lower"))
            lower = grams.withColumn("rest", F.expr("substring(gram, 2)")).join(shorter, ["lang", "rest"])
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        out.append(store(lower.select("lang", "gram", p.alias("value")), "kn-grams", rows))
        out.append(met.select("lang", F.col("context").alias("gram"), F.col("weight").alias("value")))
    return out


def fit(training: DataFrame, shape: Shape = Shape()) -> Model:
    """``training``: (lang, text). The driver gets the names of the languages and of the shards only."""
    spark = training.sparkSession
    tables = order_tables(gram_counts(training, shape), shape)
    names = sorted(r["lang"] for r in tables[0].select("lang").distinct().collect())  # those with a letter
    if not names:
        return Model(())
    uniform = 1.0 / (1 + tables[0].select("gram").distinct().count())
    parts = smoothed(tables, uniform)
    bits = tuple(max(0, (part.count() - 1) // shape.shard_entries).bit_length() for part in parts)
    places, folder = {name: n for n, name in enumerate(names)}, shared_folder(spark, "kn-model")
    entry = "part int, shard long, hash long, lang int, value double"

    def hashed(part: int):
        size = part // 2 + (part + 1) % 2

        def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = values(batch, "gram")
                keys = gram_hash(point_columns(grams, size)) if size else np.zeros(len(grams), np.uint64)
                langs = np.fromiter((places[x] for x in values(batch, "lang")), np.int32, len(grams))
                arrays = [np.full(len(grams), part, np.int32), shard_of(keys, bits[part]), keys.view(np.int64), langs]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), batch.column(2)], ["part", "shard", "hash", "lang", "value"])

        return rows

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finish() -> pa.RecordBatch:
            hashes, langs, numbers = (np.concatenate(x) for x in zip(*held))
            by = np.lexsort((langs, hashes))
            file = SharedFile(folder, f"{at[0]}-{at[1]}")
            for array, kind in ((hashes, "<u8"), (numbers, "<f8"), (langs, "<i4")):
                file.write(array[by].astype(kind).tobytes())
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64())], ["part", "shard"])

        for batch in batches:
            part, shard, hashes, langs, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(shard) != 0)) + 1
            for rows in np.split(np.arange(len(part)), cuts):
                if not len(rows):
                    continue
                key = (int(part[rows[0]]), int(shard[rows[0]]))
                if at not in (None, key):
                    yield finish()
                    held = []
                at = key
                held.append((hashes[rows].view(np.uint64), langs[rows], numbers[rows]))
        if held:
            yield finish()

    entries = None
    for number, part in enumerate(parts):
        rows = part.mapInArrow(hashed(number), entry)
        entries = rows if entries is None else entries.unionAll(rows)
    dealt = entries.repartition("part", "shard").sortWithinPartitions("part", "shard")
    filled = store(dealt.mapInArrow(written, "part int, shard long"), "kn-shards", 1)
    filled = frozenset((r["part"], r["shard"]) for r in filled.collect())
    drop(*tables, *parts)
    return Model(tuple(names), shape.order, folder, bits, filled, uniform, shape.held_entries)


def point_columns(grams: list[str], size: int) -> list[np.ndarray]:
    points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").reshape(-1, size)
    return [np.ascontiguousarray(points[:, i]) for i in range(size)]


def entropies(texts: list[str | None], model: Model, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(characters per text, cross-entropy in nats per character by text and language)."""
    sums = np.zeros((len(texts), len(model.names)))
    chars, inked = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, block in slices(texts, max(1000, min(shape.block_chars, shape.cells // len(model.names)))):
        owner, columns = characters(block, model.order)
        if not len(owner):
            continue
        at = np.array(rows)[owner]
        chars += np.bincount(at, minlength=len(texts))
        inked += np.bincount(at[columns[-1] != SPACE], minlength=len(texts))
        _, first, where = np.unique(gram_hash(columns), return_index=True, return_inverse=True)
        cost = -np.log(model.probabilities([c[first] for c in columns]))
        for i in range(cost.shape[1]):
            sums[:, i] += np.bincount(at, weights=cost[where, i], minlength=len(texts))
    chars[inked == 0] = 0
    return chars, sums / np.maximum(chars, 1)[:, None]


OUT = "lang_pred string, score double, cross_entropy double"


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row per row of ``docs``: key, ``lang_pred``, ``score`` and ``cross_entropy``."""
    names = model.names

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = values(batch, "text")
            rows = [("und", 0.0, None)] * len(texts)
            if names:
                chars, cost = entropies(texts, model, shape)
                best = cost.argmin(1)
                least = cost[np.arange(len(texts)), best]
                sharp = np.minimum(chars, shape.evidence)[:, None]
                share = 1 / np.exp((least[:, None] - cost) * sharp).sum(1)
                for n in np.flatnonzero(chars).tolist():
                    name = names[best[n]]
                    rows[n] = (name, float(share[n]), float(least[n]))
            columns = list(zip(*rows)) if rows else [()] * 3
            types = (pa.string(), pa.float64(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, *[c.split()[0] for c in OUT.split(", ")]])

    picked = docs.select(docs[key], docs[text].alias("text"))
    return picked.mapInArrow(scored, f"`{key}` {docs.schema[key].dataType.simpleString()}, {OUT}")


def rejections(found: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``found``: stored rows of ``identify`` with ``lang`` where they were learnt from, else null; adds ``rejected``."""
    right = found.where("lang = lang_pred AND cross_entropy IS NOT NULL")
    limits = right.groupBy("lang").agg(F.percentile_approx("cross_entropy", shape.accept).alias("limit"))
    limits = store(limits.select(F.col("lang").alias("lang_pred"), "limit"), "kn-limits")
    return with_small(found.alias("f"), limits.alias("l"), F.expr("f.lang_pred = l.lang_pred"), "left").select(
        "f.*", F.coalesce(F.col("cross_entropy").isNull() | (F.col("cross_entropy") > F.col("limit")), F.lit(False)).alias("rejected")
    )


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", shape: Shape = Shape()) -> DataFrame:
    """Learn from the rows that are not held out and predict all; adds ``held_out``."""
    known = docs.where(~held_out(docs[key]) & docs[lang].isNotNull() & docs[text].isNotNull())
    training = known.select(docs[lang].alias("lang"), docs[text].alias("text"))
    model = fit(training, shape)
    learnt = F.when(~held_out(docs[key]) & docs[text].isNotNull(), docs[lang])
    rows = docs.select(F.struct(docs[key].alias("key"), learnt.alias("lang")).alias("row"), docs[text].alias("text"))
    found = identify(rows, model, "row", "text", shape).select("row.key", "row.lang", "lang_pred", "score", "cross_entropy")
    found = rejections(store(found, "kn-found"), shape).withColumnRenamed("key", key)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
