"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = [a + b for a in ("th", "an", "re", "on", "ti", "en", "or", "ha", "wh", "es") for b in ("er", "ing", "ed", "ly", "st", "nd", "ea", "ou", "at", "is")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def row(i, text, source="src1"):  # noqa: ANN001, ANN201
    return (i, text, "en", source, None if text is None else len(text))


def awkward() -> list[tuple]:
    long = prose(9001, 30_000)
    return [
        row(1, prose(9010, 120)), row(2, None), row(3, ""), row(4, "  \n\t "), row(5, long), row(6, prose(9010, 120), None), row(7, "one"),
        row(8, prose(9011, 80)), row(8, prose(9011, 80)), row(None, prose(9012, 60)), row(None, None, None), row(9, "x" * 50_000), row(10, "é ß 😀 中文 " * 30),
    ]


def clashing(df):  # noqa: ANN001, ANN201
    """df with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("h", "pos", "first", "fp", "a", "b", "u", "v", "id", "root", "host", "keep", "words", "n", "count", "at", "key", "x.y"):
        df = df.withColumn(name, F.lit("mine"))
    return df
