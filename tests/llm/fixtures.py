from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, k1 int, row string, score double, label int"


def documents(spark, texts):
    """Rows with ids from 0 and extra columns whose names the operators use themselves."""
    rows = [(i, t, i, f"r{i}", 0.5, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a very long word and text."""
    long_text = " ".join(random.Random(1).choice(["alpha", "Beta.", "gamma", "\n"]) for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "A" * 30_000), (5, long_text), (None, "no id here"),
            (None, None), (7, "same row twice"), (7, "same row twice"), (7, "same id, other text"),
            (8, "x\x00y   \U0001f600 <|endoftext|> é"), (9, "tie"), (10, "tie")]
    return spark.createDataFrame([(i, t, 1, "r", 0.5, 0) for i, t in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
