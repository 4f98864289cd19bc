"""Small tables with everything that may go wrong in one."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        T.StructField("id", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("_text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def docs(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    full = [(i, t, lang, source, len(t) if t is not None else None, "x", "y", "z", "l", "k") for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS)


def words(n, seed, vocabulary=500):
    """A text of n invented words."""
    import random

    rng = random.Random(seed)
    letters = "etaoinshrdlu"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))
