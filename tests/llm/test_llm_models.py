import math
import zlib
import numpy as np
from helpers import clashing, documents, edge_rows, prose
from pyspark.sql import functions as F

from ledgerloom.llm import ftrl_quality, kneser_ney
from ledgerloom.llm.common import held_out
from ledgerloom.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"


def test_languages_on_held_out_texts(spark):
    found = QUERIES["op6_kneser_ney"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id")
    kept = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert kept[0] >= 0.98 and 0 <= kept[1] <= kept[2] <= 1
    assert found.where("held_out").count() == table(spark, FOLDER, "documents").where(held_out(F.col("doc_id"))).count()


def test_probabilities_sum_to_one(spark):
    texts = [("x", "abab baab abba cab"), ("x", "bac aab"), ("y", "zzz yz")]
    model = kneser_ney.fit(spark.createDataFrame(texts, "lang string, text string"))
    seen = sorted(set("".join(t for _, t in texts) + " "))
    for language in model.languages.values():
        for context in ("   ", " ab", "aba", "zzz"):
            columns = [np.array([ord(c)] * (len(seen) + 1)) for c in context] + [np.array([*map(ord, seen), ord("q")])]
            p = language.probability([c.astype(np.uint32) for c in columns])
            # the uniform share of all unseen characters is given to one of them
            assert abs(p.sum() - 1) < 0.02 and (p > 0).all()


def test_language_edges(spark):
    docs = clashing(documents(spark, [*edge_rows(), (20, "1234 !!", "en"), (21, "x" * 50, "en")]))
    found = kneser_ney.predict_languages(docs, shape=kneser_ney.Shape(block_chars=5000)).collect()
    assert len(found) == docs.count()
    assert all((r.lang_pred == "und" and r.score == 0) for r in found if r.doc_id in (2, 3, 4, 20))
    assert all(r.lang_pred != "und" for r in found if r.doc_id in (1, 5, 6, 7))
    nothing = documents(spark, [(1, "abc", None), (2, "abd", None)])
    assert [r.lang_pred for r in kneser_ney.predict_languages(nothing).collect()] == ["und", "und"]
    assert kneser_ney.predict_languages(documents(spark, [])).count() == 0


def test_slices_do_not_change_the_choice(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    one = {r.doc_id: r.lang_pred for r in kneser_ney.predict_languages(docs).collect()}
    two = {r.doc_id: r.lang_pred for r in kneser_ney.predict_languages(docs, shape=kneser_ney.Shape(block_chars=3000, task_grams=500)).collect()}
    assert sum(one[k] == two[k] for k in one) >= 0.98 * len(one)


def test_quality_on_held_out_labels(spark):
    labels = table(spark, FOLDER, "labels")
    found = QUERIES["op4_ftrl_quality"](spark, FOLDER).join(labels, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.93


def test_ftrl_learns_a_separable_rule():
    shape = ftrl_quality.Ftrl(bits=6)
    examples = [(n % 2, np.array([0, 10 + n % 2]), np.array([1.0, 1.0])) for n in range(200)]
    w = ftrl_quality.train(examples, shape)
    assert w[11] > 1 and w[10] < -1 and (w[20:] == 0).all()


def test_quality_edges(spark):
    docs = clashing(documents(spark, edge_rows()))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (7, 5, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    found = ftrl_quality.predict_quality(docs, labels).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert {r.score for r in ftrl_quality.predict_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert ftrl_quality.predict_quality(documents(spark, []), labels).count() == 0


def test_training_equals_a_scalar_version():
    """FTRL-proximal, one coordinate at a time in dictionaries."""
    rng = np.random.default_rng(4)
    shape = ftrl_quality.Ftrl(bits=5, epochs=3)
    examples = []
    for _ in range(60):
        i = np.sort(rng.choice(32, 6, replace=False))
        examples.append((int(rng.integers(2)), i, rng.random(6)))
    z, n = {}, {}

    def weight(k):
        pull = z.get(k, 0.0)
        if abs(pull) <= shape.l1:
            return 0.0
        return ((1 if pull > 0 else -1) * shape.l1 - pull) / ((shape.beta + math.sqrt(n.get(k, 0.0))) / shape.alpha + shape.l2)

    for _ in range(shape.epochs):
        for label, index, x in examples:
            w = {k: weight(k) for k in index.tolist()}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in zip(index.tolist(), x.tolist()))))
            for k, v in zip(index.tolist(), x.tolist()):
                g, old = (p - label) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / shape.alpha * w[k]
                n[k] = old + g * g
    assert np.allclose(ftrl_quality.train(examples, shape), [weight(k) for k in range(32)], atol=1e-9, rtol=0)


def test_very_long_labelled_texts_train(spark):
    good, bad = "alpha beta gamma " * 15_000, "omega sigma theta " * 15_000
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:80]
    docs = documents(spark, [(i, good if k % 2 else bad) for k, i in enumerate(ids)] + [(100_000, "alpha beta gamma"), (100_001, "omega sigma theta")])
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    found = {r["doc_id"]: r["score"] for r in ftrl_quality.predict_quality(docs, labels).collect()}
    assert found[100_000] > 0.5 > found[100_001] and found[ids[1]] > 0.5 > found[ids[0]]
