"""Small document tables with the odd rows that every operator must take."""

import random

from pyspark.sql import functions as F

WORDS = "the of and river stone light under winter garden letter morning never seven paper quiet window yellow harbour music travel".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "er", "ly"]) for _ in range(n))


def documents(spark, texts, ids=None, extra=True):
    """doc_id, text, lang, source, n_chars, and columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("digest", "g", "key", "node", "score", "bucket", "locator", "content", "positive", "ids"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def odd_texts():
    """Null, empty, white space, one word, ties, a repeated row and a very long text."""
    long = prose(1, 30_000)
    return [None, "", " \t\n", "word", "a b", "a  b", "a\tb", prose(2, 80), prose(2, 80), prose(3, 80).upper(), long, long + " end", "ä ß 語 😀"]
