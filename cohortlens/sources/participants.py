"""Participants tables: tab-separated text with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scalar import label_or_raw

NUMBERS = ("Age", "MMSE")


def read_participants(spark: SparkSession, path: str, label_column: str = "Group", label_map: dict[str, str] | None = None) -> DataFrame:
    """The table with stripped column names and label: the mapped group, or the group itself.

    Every column is read as text; Age and MMSE become numbers, null where they are none (n/a).
    """
    raw = spark.read.option("sep", "\t").option("header", "true").csv(path)
    table = raw.toDF(*(c.strip() for c in raw.columns))
    table = table.withColumns({c: F.col(c).try_cast("double") for c in NUMBERS if c in table.columns})
    return table.withColumn("label", label_or_raw(F.col(label_column), label_map or {}))
