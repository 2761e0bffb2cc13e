"""Documents with every awkward case the operators define."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n))


LONG = prose(1, 30_000)
ROWS = [
    (1, "Hello world, hello again.", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"), (5, LONG, "en"), (6, LONG, "en"), (6, LONG, "en"),
    (7, "é́ Σίσυφος İstanbul 　 ÀÉ", "el"), (8, "a\n\nb\r\n  c", "en"), (None, "no id here", "en"), (9, "x" * 50_000, None), (10, "1 2 3 " * 5_000, "en"),
]
SCHEMA = "doc_id long, text string, lang string"


def documents(spark, rows=ROWS):
    """With extra columns whose names clash with what the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("t", "d", "fp", "n", "h", "key", "word", "pos", "line", "uid", "score", "spans", "gone", "source", "n_chars")})


def empty(spark):
    return documents(spark).where("false")
