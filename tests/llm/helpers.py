"""Small document tables for the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """``rows``: (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, words, vocabulary=4000):
    """Words of random syllables: ordinary text, as far as compression and shingles go."""
    rng, dealt = random.Random(seed), random.Random(7)
    pool = ["".join(dealt.choice("aeiou") + dealt.choice("bcdfghlmnprst") for _ in range(dealt.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(pool) for _ in range(words))


def edge_rows():
    """Nulls in every column, empty and blank texts, repeated rows, a repeated id with another text, a long text."""
    long = prose(99, 30_000)
    return [
        (1, prose(1, 120), "en", "a"),
        (1, prose(1, 120), "en", "a"),
        (1, prose(2, 80), "en", "b"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n", "de", ""),
        (None, prose(1, 120), None, "a"),
        (None, None, None, None),
        (5, long, "en", "c"),
        (6, "one", "en", "c"),
        (7, prose(1, 120), "fr", "ö"),
    ]


#: Columns that the operators use inside or return.
CLASH = "kept n_words row rows fp h size id v sha start score found rules s key ratio __h __k __n __copy".split()


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("mine") for name in CLASH})
