"""Rows that every operator must take: nulls, empty and blank and very long texts, ties, repeats, clashing columns."""

LONG = "long " + "word stream with no end " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "en", "b"),
    (5, LONG, "en", "b"),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", None),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", None),
    (7, "Ünïcode — ß İ é H̱ \x1c x y \U0001f600 <|endoftext|> d'accord 12,5 (a.b)", "fr", "é"),
    (8, "...!!!", None, "a"),
    (None, "a row without an id", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string"
CLASH = ["fp", "fingerprint", "component_id", "block", "place", "s", "key", "id", "label", "features", "size_", "row_", "pii", "toxicity", "language_id", "mix_shard"]


def docs(spark, rows=ROWS, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, COLUMNS)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH]) if clash else df


def none(spark):
    return docs(spark).limit(0)
