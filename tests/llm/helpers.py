"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """Words that no other seed gives."""
    import random

    r = random.Random(seed)
    return " ".join(f"{''.join(r.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(r.randint(3, 9)))}" for _ in range(n))


def odd_documents(spark):
    """Every oddity at once; the long text has one line of 30,000 words."""
    a, b = prose(1, 80), prose(2, 60)
    rows = [
        (1, a, "en", "s"), (2, a, "en", "s"), (3, a + " more", "en", "t"), (4, b, None, None), (5, None, None, None), (6, "", "en", "s"), (7, " \n\t\n ", "en", "s"),
        (8, prose(3, 30000), "en", "s"), (9, "one", "de", "s"), (9, "two words", "de", "s"), (10, b, "en", "u"), (10, b, "en", "u"), (None, prose(4, 50), "en", "u"),
        (None, None, None, None), (11, "Zeile\r\nZeile\n\u00e9\U0001f600 x", "de", "u"),
    ]
    return spark.createDataFrame([(i, t, la, so, None if t is None else len(t)) for i, t, la, so in rows], DOCS)


def clashing(df):
    """df with more columns, named as operators name theirs."""
    from pyspark.sql import functions as F

    for name in ("k1", "k2", "h1", "pos", "line", "key", "words", "tokens", "score", "size", "u", "node", "fp", "_k1", "_drop", "_n", "_key", "_a", "row", "n_lines", "n_dropped", "copy_no", "copies", "extra", "taken",
                 "target", "source_size", "grade", "given", "digest", "w", "class_id", "class_size", "kept", "predicted", "item_id", "t", "n", "part", "spot", "in_doc_id",
                 "fingerprint", "edited", "next_text", "bucket", "rid", "total"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df
