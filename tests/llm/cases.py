"""Rows that every operator on documents must survive."""

import random

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))


def edge_rows():
    return [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n\r\x0b\x0c ", None, None, None),
        (4, "one", "fr", "a", 3),
        (5, "The quick brown fox jumps over the lazy dog and then it runs away from here", "en", "a", 1),
        (5, "The quick brown fox jumps over the lazy dog and then it runs away from here", "en", "a", 1),
        (6, "The quick brown  fox jumps over the lazy dog and then it runs away from here\n", "en", "b", 1),
        (None, "The quick brown fox jumps over the lazy dog and then it runs away from here", "en", "b", 1),
        (7, LONG, "de", "hot", 1),
        (8, LONG + " tail", "de", "hot", 1),
        (9, "naïve café Straße İstanbul ΣΑΣ  x y \U0001f600 漢字 'S don't I'LL <|endoftext|> </s>", "es", "hot", 1),
        (10, "a\nb\na\nb\n\n \na", "es", "hot", 1),
        (11, "!!! ### 123 4567", "es", "hot", 1),
        (12, "x" * 5000, "es", "hot", 1),
    ] + [(100 + k, "copy of one text that many rows share in this table", "en", "hot", 1) for k in range(40)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark, clashing=True):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        for name in ("rid", "head", "fp", "key", "u", "v", "n", "n_words", "kept", "ids", "score", "count", "value", "component_id", "digest", "_text", "length", "near row", "grace digest", "row", "c0", "document", "d0", "f0", "a.b", "file", "terms"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def near_texts(n, seed=1):
    """Texts in families whose members differ in a few words."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "el", "os", "ur", "ix")]
    out = []
    for family in range(n // 10):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 120, 300]))]
        for _ in range(10):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out
