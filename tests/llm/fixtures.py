"""Rows that operators must stand."""

import random

from pyspark.sql import types as T

#: Documents with columns whose names operators use themselves.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("p", T.StringType()),
    ]
)


def row(ident, text, source="a"):
    return (ident, text, "en", source, "s", 1, "x", "y", "z")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    pool = ["the", "of", "river", "stone", "Über", "naïve", "walks", "blue", "seven", "don't", "and", "light,", "end."]
    pool += [f"w{rng.randrange(500)}" for _ in range(40)]
    return " ".join(rng.choice(pool) for _ in range(words))


def messy_rows() -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, equal ids, copies, near copies and null sources."""
    base = prose(1, 120)
    near = base.split()
    near[3] = "changed"
    return [
        row(1, base),
        row(2, base),
        row(3, " ".join(near), "b"),
        row(4, None),
        row(5, ""),
        row(6, " \n\t "),
        row(7, "one", None),
        row(8, "word " * 30_000, "b"),
        row(9, "x" * 100_000, None),
        row(10, prose(2, 80)),
        row(10, prose(2, 80)),
        row(11, prose(3, 60)),
        row(11, prose(4, 60), "b"),
        row(None, prose(5, 50)),
        row(None, None),
        row(12, "|| ;; --", "c"),
        row(13, "a\x0b\x1cb 日本語。 ﬁ <|endoftext|> <s>\r\n é", "c"),
        *(row(100 + i, prose(100 + i, 20 + i), "abc"[i % 3]) for i in range(40)),
    ]
