"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are words and runs of punctuation, ASCII lower-cased. Features are hashed uni- and bigrams, plus one for every
three-word window that occurred before in the text; each occurrence weighs ``1 / sqrt(tokens)``. A score is the
logistic of a sparse dot product, computed in a narrow stage over whole texts.

Training: a bounded sample of labelled documents (``sample`` ids in hash order), chosen by their ids alone; their whole
texts, of any length, become sparse feature vectors in parallel. Per-coordinate FTRL-proximal updates are sequential by
nature and run over these vectors in one task. The result is one array of ``2**bits`` weights.

A null or empty text has no features and gets the score of the bias. Without labels every score is 0.5, and without
documents there is no row. Labels other than 0 and 1 are ignored; of repeated labels of a document the smallest counts,
and of rows that repeat a labelled id the first by text hash trains. Very long texts train and are scored whole. Equal
scores are equal; nothing is ranked. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ASCII_LOWER, held_out, raw, store, values
from ledgerloom.llm.super_kmers import WordHash, mixed


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    sample: int = 12_000
    epochs: int = 4
    alpha: float = 0.15
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    block_tokens: int = 400_000


TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
BIAS, AGAIN = 0, 1


def features(texts: list[bytes], bits: int, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature) of every occurrence, and (tokens, repeated windows) per text."""
    tokens = [TOKEN.findall(t.translate(ASCII_LOWER)) for t in texts]
    lengths = np.fromiter(map(len, tokens), np.int64, len(texts))
    words = np.fromiter((h for t in tokens for h in map(hashes.__getitem__, t)), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    with np.errstate(over="ignore"):
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        inside = owner[:-1] == owner[1:]
        triples = mixed(pairs[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[2:] + owner[2:].astype(np.uint64))
    whole = inside[:-1] & inside[1:] if len(inside) > 1 else np.zeros(0, bool)
    triples, of = triples[: len(whole)][whole], owner[2:][whole]
    first = np.unique(triples, return_index=True)[1]
    again = np.bincount(of, minlength=len(texts)) - np.bincount(of[first], minlength=len(texts))
    shift = np.uint64(64 - bits)
    index = np.concatenate([mixed(words) >> shift, pairs[inside] >> shift]).astype(np.int64)
    return np.concatenate([owner, owner[:-1][inside]]), index | 2 * (index < 2), lengths, again


def text_blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    """(other columns as rows, texts) in blocks of about ``size`` tokens; the text is the last column."""
    rows, texts, held = [], [], 0
    for batch in batches:
        others = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for *row, body in zip(*others, raw(batch, "text")):
            rows.append(row)
            texts.append(body or b"")
            held += len(texts[-1]) // 6
            if held > size:
                yield rows, texts
                rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def train(examples: Iterable[tuple[int, np.ndarray, np.ndarray]], shape: Ftrl) -> np.ndarray:
    """FTRL-proximal over (label, features, values)."""
    z, n = np.zeros(1 << shape.bits), np.zeros(1 << shape.bits)
    examples = list(examples)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        pull = np.sign(z[i]) * shape.l1 - z[i]
        return np.where(np.abs(z[i]) <= shape.l1, 0.0, pull / ((shape.beta + np.sqrt(n[i])) / shape.alpha + shape.l2))

    for _ in range(shape.epochs):
        for label, i, x in examples:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / shape.alpha * w
            n[i] += g * g
    return weights(slice(None))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", shape: Ftrl = Ftrl()) -> np.ndarray:
    """Weights learnt from ``labels`` (key, label) that are not held out."""
    usable = labels.where(labels[label].isin(0, 1) & labels[key].isNotNull() & ~held_out(labels[key]))
    one = usable.groupBy(usable[key].alias("id")).agg(F.min(label).cast("int").alias("label"))
    chosen = store(one.orderBy(F.xxhash64("id"), "id").limit(shape.sample), "ftrl-labels")
    texts = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    met = texts.join(F.broadcast(chosen), "id")  # at most ``sample`` labels
    # One row per id: Spark limits each group before the exchange, so a repeated id does not travel with all its rows.
    first = Window.partitionBy("id").orderBy(F.xxhash64("text"))
    met = met.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").withColumn("place", F.xxhash64("id"))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for rows, texts in text_blocks(batches, shape.block_tokens):
            owner, index, lengths, again = features(texts, shape.bits, hashes)
            order = np.argsort(owner, kind="stable")
            per = np.split(index[order], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
            out = []
            for (place, mark), own, size, repeats in zip(rows, per, lengths.tolist(), again.tolist()):
                i, times = np.unique(own, return_counts=True)
                i = np.concatenate(([BIAS, AGAIN], i)).astype(np.int32)
                x = np.concatenate(([1.0], np.concatenate(([repeats], times)) / max(1, size) ** 0.5)).astype(np.float32)
                out.append((place, mark, i.tobytes(), x.tobytes()))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["place", "label", "i", "x"])

    def learnt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for place, mark, i, x in zip(*(values(batch, c) for c in ("place", "label", "i", "x"))):
                examples.append((place, mark, i, x))
        if examples:
            examples.sort()  # the order of training does not depend on the partitions
            examples = [(mark, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32).astype(float)) for _, mark, i, x in examples]
            yield pa.RecordBatch.from_arrays([pa.array([train(examples, shape).astype("<f8").tobytes()])], ["w"])

    shaped = met.select("place", "label", "text").mapInArrow(featured, "place long, label int, i binary, x binary")
    sample = store(shaped, "ftrl-sample")
    found = sample.coalesce(1).mapInArrow(learnt, "w binary").collect()
    return np.frombuffer(found[0]["w"], "<f8") if found else np.zeros(1 << shape.bits)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", shape: Ftrl = Ftrl()) -> DataFrame:
    """(key, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, w = WordHash(), sent.value
        for rows, texts in text_blocks(batches, shape.block_tokens):
            owner, index, lengths, again = features(texts, shape.bits, hashes)
            dot = np.bincount(owner, weights=w[index], minlength=len(texts)) + again * w[AGAIN]
            margin = w[BIAS] + dot / np.sqrt(np.maximum(lengths, 1))
            shown = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key_type), pa.array(shown)], [key, "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(kind)
    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(scored, f"`{key}` {kind.simpleString()}, score double")


def predict_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", at: float = 0.7, shape: Ftrl = Ftrl()) -> DataFrame:
    """One row per row of ``docs``: key, ``held_out``, ``score`` and ``predicted``."""
    found = score(docs, fit(docs, labels, key, text, shape=shape), key, text, shape)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
