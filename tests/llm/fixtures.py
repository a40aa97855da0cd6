"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated
rows, and extra columns whose names clash with those the operators make."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, size long, score double, row string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "ke", "li", "mo", "nu", "ra", "so", "té"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts() -> list:
    base = words(1, 200)
    near = base.split()
    near[50] = "changed"
    far = base.split()
    far[::12] = ["x%d" % i for i in range(len(far[::12]))]
    return [base, base.upper().replace("É", "é"), " ".join(near), " ".join(far), words(2, 3), words(2, 3).capitalize(), "", None, " \t\n ",
            words(3, 5000), words(4, 40), "Ä ä Ö", "ä ä ö", "one two three four five six", "One two three four five six", words(5, 80)]


def rows() -> list:
    out = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), "s", i, 0.5, "r") for i, t in enumerate(texts())]
    out.append(out[4])  # a repeated row
    out.append((None, "no identifier at all in this row", None, "a", None, None, None, None, None))
    return out


def docs(spark, extra=()):
    return spark.createDataFrame(rows() + list(extra), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def many(spark, n: int, seed: int = 0, copies: int = 0):
    """Random documents of 1 to 60 words, with ``copies`` repeats of one text."""
    data = [(i, words(seed * 1000 + i, 1 + i * 7 % 60), "en", f"s{i % 5}", 0, "", 0, 0.0, "") for i in range(n)]
    data += [(n + i, "the same text again and again in many rows", "en", "s0", 0, "", 0, 0.0, "") for i in range(copies)]
    return spark.createDataFrame(data, DOCS).repartition(4, F.col("doc_id"))
