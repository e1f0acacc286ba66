"""Awkward texts and tables for the tests of this folder."""

import random
import re

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ein", "über", "naïve", "Ström", "x1", "río", "zeta", "kappa", "mu", "nu", "xi", "pi"]) + rng.choice(["", "", "a", "b", "c", ",", "."]) for _ in range(n))


def awkward(rng=None):
    rng = rng or random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 300)
    return [
        None,
        "",
        " ",
        "\n\n \n",
        "a",
        "one two three",
        "same line\nsame line\n\nsame line\nother",
        "tab\tnew\x0bline\x0cpage\rreturn word",
        "é" * 50 + " \U0001f600 \U0001f600 # $ % | <a> & *",
        "no\xa0break space em",
        long,
        base,
        base,
        base + " tail",
        "a b c d e a b c d e a b c d e f g",
        words(rng, 12),
        words(rng, 13),
        words(rng, 14),
        "\n".join(thue_morse("a", "b")),
        *(f"{x} {x[:300]}" for x in thue_morse("a", "b")),
        " ".join(thue_morse("x ", "y ")),
    ]


def thue_morse(a, b, doublings=10):
    """Two different strings that every polynomial hash modulo 2**64 takes for equal."""
    x, y = a, b
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def documents(spark, texts, extra=()):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCUMENTS)
