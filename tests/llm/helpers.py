"""Small tables with the awkward rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra array<int>, fileid int"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"src{i % 3}", None if t is None else len(t), [i], i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    long = "word " * 30000
    rows = [(1, None, None, None, None, None, None), (None, "a b c", "en", "s", 5, [1], 1), (2, "", "en", None, 0, [], 2), (3, long, "en", "s", len(long), None, 3), (3, long, "en", "s", len(long), None, 3), (4, "  \n\t ", None, "s", 5, None, 4), (5, "né à l'été \U0001f600 x", "fr", "s", 9, None, 5), (6, "x" * 50000, "en", "s", 50000, None, 6)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
