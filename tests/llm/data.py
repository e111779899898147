"""Small tables with the awkward cases: nulls, empties, ties, repeats, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra=()):
    """rows: (doc_id, text); extra: names of further columns."""
    data = [(i, t, "en", None if (i or 0) % 3 == 0 else "src0", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


AWKWARD = [
    (1, "The quick brown fox"), (2, "Thequick  brown\tfox\n"), (3, None), (4, ""), (5, " \n\t"), (6, "The quick brown fox"),
    (6, "The quick brown fox"), (7, "ünïcödé 漢字 🎉 text"), (8, "x" * 70_000), (None, "no id here"), (None, None),
    (9, "ΣΑΣ İstanbul don't 12345 <|endoftext|>"), (10, "  leading and   inner \r\n\r\n spaces  "),
]


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et".split()) + str(rng.randrange(40)) for _ in range(n)]
