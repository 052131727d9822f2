"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, line string, size long, score double, h long"


def docs(spark, rows):
    """A documents table with further columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), "x", "y", -1, -1.0, 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, words=None):
    pick = random.Random(seed)
    words = words or ["the", "of", "and"] + [f"{a}{b}{c}" for a in ("th", "re", "on") for b in ("ing", "er", "at") for c in ("", "s", "ed")]
    return " ".join(pick.choice(words) for _ in range(n))


def odd_rows():
    base = prose(1, 60)
    long = prose(2, 60_000)
    return [
        (1, base, "a"), (2, base, "b"), (3, base + " more", "b"), (4, None, None), (5, "", "a"), (6, "   \n\t ", None), (7, "one", "c"), (8, "one two", "c"),
        (9, long, "a"), (10, long.replace("the", "thee", 1), "a"), (11, "Ünï cödé ünï cödé 😀 😀 😀", "d"), (11, "Ünï cödé ünï cödé 😀 😀 😀", "d"),
        (None, base, "a"), (None, None, None), (12, "x" * 300_000, "e"), (13, base.upper(), "A"), (14, "a\nb\n\nc\r\nd", "f"),
    ]
