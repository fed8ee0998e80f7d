"""Small documents with hard cases."""

import random

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def hard_cases() -> list[tuple]:
    """(doc_id, text): null, empty, blank, short, very long, repeated, near copies, odd characters."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "ONE  two"), (5, base), (6, base), (7, " ".join(near)), (8, prose(2, 20_000)), (9, base.upper()), (10, "é ü\n▁x  y \U0001f600\n\nend "), (11, "a b c d e"), (12, prose(3, 60) + "\n" + prose(4, 70)), (13, prose(5, 50) + "\n" + prose(4, 70))]
    near2 = near[:]
    near2[10] = "other"
    near2[100] = "thing"
    rows.append((14, " ".join(near2)))
    return rows + [(100 + k, prose(50 + k, 40) + "\nShared  Line \n" + prose(70 + k, 10)) for k in range(12)]


SCHEMA = "doc_id long, text string, n_lines string, token string"


def table(spark, rows=None):
    """With extra columns whose names clash with those of the operators."""
    rows = hard_cases() if rows is None else rows
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3)
