"""Small tables with everything odd at once: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 5000


def documents(spark):
    rows = [
        (1, "The cat sat on the mat", "s1"), (1, "The cat sat on the mat", "s1"), (2, "the CAT sat on the mat", "s1"),
        (3, None, "s2"), (4, "", "s2"), (5, " \n\t ", None), (6, LONG, "s2"), (7, LONG + "epsilon", "s3"),
        (None, "a row without a key", None), (None, None, None), (8, "naïve Ünïcode 　 <|endoftext|> x's 12½", "s3"), (9, "one", "s3"), (10, "one two", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in ("k", "id", "fp", "size", "score", "t", "d", "h", "lang", "n", "__key", "run")})


def empty(df):
    return df.limit(0)


def by(rows, key="doc_id"):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) if not isinstance(x, list) else (True, str(x)) for x in r])
