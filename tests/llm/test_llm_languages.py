"""Language models against a version with dictionaries, without limits on languages or entries."""

import math
from collections import Counter

import numpy as np
from helpers import documents, prose
from pyspark.sql import functions as F

from ledgerloom.llm import kneser_ney
from ledgerloom.llm.common import held_out

SCHEMA = "lang string, text string"


def grams_of(text, order):
    body = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = [c for n, c in enumerate(body) if c != " " or (n and body[n - 1] != " ")]
    padded = [" "] * (order - 1) + kept
    return ["".join(padded[i : i + order]) for i in range(len(kept))]


class Dictionaries:
    """Interpolated Kneser-Ney of one language, straight from the formulas."""

    def __init__(self, texts, order, uniform):
        self.order, self.uniform = order, uniform
        self.counts = [Counter(g for t in texts for g in grams_of(t, order))]
        for _ in range(order - 1):
            self.counts.insert(0, Counter(g[1:] for g in self.counts[0]))
        self.discounts = []
        for counts in self.counts:
            n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
            self.discounts.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)

    def p(self, gram):
        if not gram:
            return self.uniform
        counts, d = self.counts[len(gram) - 1], self.discounts[len(gram) - 1]
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        lower = self.p(gram[1:])
        if not after:
            return lower
        return max(counts[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * lower


def brute(training, texts, order=4):
    held = {}
    for lang, text in training:
        held.setdefault(lang, []).append(text)
    alphabet = {g for _, text in training for g in grams_of(text, 1)}
    models = {k: Dictionaries(v, order, 1 / (1 + len(alphabet))) for k, v in sorted(held.items())}
    out = []
    for text in texts:
        grams = Counter(grams_of(text, order))
        out.append([sum(-math.log(m.p(g)) * c for g, c in grams.items()) / max(1, sum(grams.values())) for m in models.values()])
    return np.array(out)


TRAINING = [
    ("de", "Der schnelle Fuchs springt über den faulen Hund. " * 2 + "Über 7 Hügel!"), ("en", "The quick brown fox jumps over the lazy dog."),
    ("en", "Then the other fox, the slower one, left. the the"), ("ru", "быстрая лиса прыгает"), ("x", "aaa aab aba"),
]
TEXTS = ["The fox", "Fuchs über Hügel", "лиса the", "zzz 99 qqq", "a", "aaaaab ab  a\n\nб", "The quick brown fox jumps over the lazy dog. " * 30]


def test_entropies_equal_dictionaries(spark):
    for shape in (kneser_ney.Shape(), kneser_ney.Shape(order=3, shard_entries=7, held_entries=20), kneser_ney.Shape(order=1)):
        model = kneser_ney.fit(spark.createDataFrame(TRAINING, SCHEMA), shape)
        assert model.names == ("de", "en", "ru", "x")
        assert np.allclose(kneser_ney.entropies(TEXTS, model, shape)[1], brute(TRAINING, TEXTS, shape.order), atol=1e-9, rtol=0)


def test_small_shards_change_nothing(spark):
    training = spark.createDataFrame([(f"l{n % 3}", prose(n, 400)) for n in range(6)], SCHEMA)
    texts = [prose(n, 50) for n in range(20)]
    found = []
    for shape in (kneser_ney.Shape(), kneser_ney.Shape(shard_entries=50, held_entries=120)):
        kneser_ney.SHARDS.clear()
        model = kneser_ney.fit(training, shape)
        found.append(kneser_ney.entropies(texts, model, shape)[1])
        assert max(model.bits) == 0 or max(number for _, number in model.filled) > 10
        assert sum(len(s[0]) for s in kneser_ney.SHARDS.values()) <= shape.held_entries
    assert np.array_equal(*found)


def test_more_than_64_languages_are_learnt(spark):
    # every language writes with three letters of its own
    words = [" ".join("".join(chr(0x4E00 + 3 * n + (i * k + k) % 3) for i in range(4)) for k in range(1, 12)) for n in range(70)]
    ids = [r.id for r in spark.range(1000).where(~held_out(F.col("id"))).limit(70).collect()]
    rows = [(i, words[n], f"l{n}") for n, i in enumerate(ids)] + [(10_000 + n, words[n], None) for n in range(70)]
    found = {r.doc_id: r.lang_pred for r in kneser_ney.predict_languages(documents(spark, rows)).collect()}
    assert [found[10_000 + n] for n in range(70)] == [f"l{n}" for n in range(70)]
