"""Small tables for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Null and empty texts, a null id, one long text.
EDGE = [(500, None), (501, ""), (None, "x " * 60), (None, None), (502, " \t\n"), (503, "long " * 3000)]


def table(spark, rows, more: str = "", *values):
    """(doc_id, text), and constant columns ``more``."""
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for field, value in zip([x.split() for x in more.split(", ") if x], values, strict=True):
        frame = frame.withColumn(field[0], F.lit(value).cast(field[1]))
    return frame


def ordered(rows):
    return sorted(rows, key=repr)


def clashing(frame):
    """Extra columns under the names that operators use themselves."""
    for name in ("ref", "row", "places", "print", "score", "ids", "items", "key", "place", "kept"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame
