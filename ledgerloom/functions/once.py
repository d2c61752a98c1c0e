"""Expensive row expressions, evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, kept: list, computed: list[Column]) -> DataFrame:
    """Select ``kept`` and ``computed``; later filters on computed columns stay above them.

    Filter pushdown replaces a column by its expression wherever the filter mentions it, so
    a JSON or hex parse would run once per mention. A one-element explode is a boundary
    pushdown does not cross.
    """
    row = F.explode(F.array(F.struct(*computed))).alias("_row")
    return df.select(*kept, row).select("*", "_row.*").drop("_row")
