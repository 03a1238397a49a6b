"""Small tables with the cases that every operator must take: nulls, empty and long texts, repeats, clashing names."""

from pyspark.sql import functions as F

CLASHING = ["size", "n", "h", "key", "id", "score", "keep_id", "kept", "hash", "row", "text_sha256", "column_0", "_text", "_id", "_key", "shingles", "component", "_source", "_carry_text", "part", "spans"]


def words(seed, n, vocabulary=400):
    """``n`` made-up words that follow from ``seed``."""
    out, x = [], seed * 2654435761 + 12345
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("w" + str((x >> 33) % vocabulary))
    return out


def texts():
    base = words(1, 120)
    near = list(base)
    near[60] = "changed"
    passage = words(2, 50)
    rows = [
        (10, " ".join(base), "a"), (3, "  ".join(base), "b"), (11, " ".join(near), "a"), (11, " ".join(near), "a"),
        (None, " ".join(base), None), (None, None, None), (20, None, "a"), (21, "", "b"), (22, " \t\n\x0b ", "c"), (23, "one", "c"), (24, "ONE", "c"), (25, "One two", "a"),
        (30, " ".join(words(3, 40) + passage + words(4, 20)), "a"), (31, " ".join(words(5, 7) + passage + words(6, 90)), None),
        (32, " ".join(words(7, 30) + words(8, 40) + words(9, 5) + words(8, 40)), "b"),
        (40, " ".join(words(11, 30_000, 5000)), "d"), (41, "x" * 50_000, "d"), (42, "\u00e9\u00df \u6c49\u5b57 \U0001f600 \u0301 a\u00a0b", "d"), (-5, "the end", "A"),
    ]
    return rows


def table(spark, rows=None, extra=True):
    df = spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if extra else df


def split(text):
    """Words of a text by the contracts' white space, as bytes."""
    return (text or "").encode().split()
