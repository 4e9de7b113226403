import random

import pytest

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, ties, repeated rows, copies, near copies and shared passages."""
    rng = random.Random(5)
    base, passage, long = words(rng, 300), words(rng, 70), words(rng, 6000)
    near = base.split()
    for i in (20, 150, 280):
        near[i] = "changed"
    half = base.split()[:150] + words(rng, 150).split()
    return [
        (1, base, "en", "b", 1), (2, base, "en", "b", 1), (3, " ".join(near), "en", None, 1), (4, " ".join(half), "en", "a", 1), (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \n\t ", "en", "a", 3),
        (8, "only three words", "en", "a", 1), (9, "Only three  words", "en", "a", 1), (10, f"{words(rng, 30)}\n{passage} {words(rng, 20)}", "fr", "c", 1), (11, f"{words(rng, 10)} {passage}\n{words(rng, 40)}", "fr", "c", 1),
        (12, long, "de", "c", 1), (12, long, "de", "c", 1), (None, base, "en", "b", 1), (13, f"{passage} " * 3, "en", "a", 1), (14, base.upper(), "en", "d", 1), (15, "Released under the MIT License. é日本 it's 'll", "en", "d", 1), (16, "the mit license MIT LICENSE gnu general public license", "en", "d", 1),
    ]


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The rows with extra columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, NAMES).repartition(3)
    for name in ("size", "class_id", "id", "bucket", "kept", "text_key", "target", "taken", "labels", "sequence_id", "gone", "own_row", "key"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
