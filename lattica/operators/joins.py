"""Joins whose sides may both be large.

Spark guesses a table's size from its files and columns: exploded, packed or derived rows look far smaller than they are, and would be
broadcast by way of the driver. The hint keeps such a join a shuffle; adaptive execution still splits its skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_key(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left and right joined by a shuffle on columns of both."""
    return left.join(right.hint("merge"), on, how)
