"""A documents table with everything that may go wrong, and small helpers."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators might use themselves.
EXTRA = ["key", "keys", "id", "ids", "rep", "hash", "word", "start", "end", "s", "n", "count", "y", "v", "cell", "root", "node", "last", "epochs", "copies", "tokens", "quality", "toxic", "item_id"]


def words(rng: random.Random, n: int) -> list[str]:
    syllables = "an be co di el fo ga hi ir ja ko lu me no op".split()
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def documents(spark, extra: bool = True):
    """Rows 1.. with nulls, empties, very long texts, copies, near copies and repeated rows."""
    rng = random.Random(5)
    base = words(rng, 80)
    near = [*base[:40], "changed", *base[41:]]
    long = words(rng, 30_000)
    rows = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base), "en", "a", 1), (3, " ".join(near), None, "b", None), (4, None, "en", "a", None), (5, "", "en", None, 0), (6, "   \n", "en", "b", 4),
        (7, "one", "en", "b", 3), (8, "one", None, None, None), (9, " ".join(long), "en", "a", 9), (10, " ".join(long[:15_000]), "en", "b", 9), (None, " ".join(base), "en", "a", 1), (None, None, None, None, None),
        (11, " ".join(words(rng, 60)), "en", "a", 2), (11, " ".join(words(rng, 60)), "en", "c", 2), (12, " ".join(words(rng, 70)), "en", "c", 2), (12, None, "en", "c", 2), (13, "!!! ??? ...", "en", "c", 11), (14, "x" * 200_000, "en", "c", 7), (15, "é" * 50 + " ñandú ßtraße", "de", "c", 7),
    ]
    rows += [rows[0]] * 2  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
