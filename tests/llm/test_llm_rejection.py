from pyspark.sql import functions as F

from ledgerloom.llm import kneser_ney
from ledgerloom.llm.common import held_out


def test_a_rare_language_has_a_limit(spark):
    rare = spark.range(200_000, 200_100).where(~held_out(F.col("id"))).limit(1).first()["id"]
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abc "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    few = spark.createDataFrame([(rare, "привет мир", "ru"), (300_000, "ммм ррр ввв", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in kneser_ney.predict_languages(many.unionByName(few)).where("doc_id >= 200000").collect()}
    assert found[rare].lang_pred == found[300_000].lang_pred == "ru"
    assert not found[rare].rejected and found[300_000].rejected
