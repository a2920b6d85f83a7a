"""Columns that are computed once, and rows that are spread before much work is done for each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, as those of a generator.

    The optimiser writes a plain column out again wherever it is used, also in filters that it moves below; chains of them grow plans
    by powers, and the driver's memory with them. It leaves a generator's columns as they are.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df by key over as many partitions as shuffles have: small files are one task otherwise, however much its rows become."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
