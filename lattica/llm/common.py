"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.storage import materialise, shared_dir

__all__ = ["BROADCAST_KEYS", "attach", "materialise", "pick", "release", "shared_dir", "table", "words"]

#: Keys that a broadcast side may hold: at 40 bytes a key, some 40 MB on each executor.
BROADCAST_KEYS = 1_000_000
#: Keys above this share of all rows are hot: 512 of them at most, so they can always be broadcast.
HOT_SHARE = 1 / 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by their exact names, under names of our own; the first of equal names counts.

    Other columns, also ones whose names differ in case only, can't clash with what an operator adds.
    """
    names = list(df.columns)
    for name in columns.values():
        if name not in names:
            raise ValueError(f"no column {name!r} in {names}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(name)}").alias(own) for own, name in columns.items()])


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, n_facts: int, salt: Column, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Left-join facts, unique by key, to rows, of which weight says how many have that key.

    Few facts are broadcast. Otherwise the hot ones, at most 1 / HOT_SHARE as weights add up to total,
    are broadcast and the other rows are shuffled; rows already served are spread by salt.
    """
    values = [c for c in facts.columns if c != key]
    if n_facts <= broadcast_keys:
        return rows.join(F.broadcast(facts), key, "left")
    is_hot = F.col(weight) > total * HOT_SHARE
    hot = facts.where(is_hot).select(key, F.struct(*values).alias("_hot"))
    cold = facts.where(~is_hot).select(F.col(key).alias("_k"), F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    served = rows.join(F.broadcast(hot), key, "left").withColumn("_served", F.col("_hot").isNotNull())
    served = served.withColumn("_salt", F.when(F.col("_served"), 1 + F.pmod(F.hash(salt), F.lit(2**30))).otherwise(0))
    joined = served.join(cold, (F.col(key) == F.col("_k")) & (served["_salt"] == cold["_salt"]), "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*[F.col(c) for c in rows.columns], *[found[c].alias(c) for c in values])


def release() -> None:
    """Give memory that a Python worker has freed back to the machine: workers stay alive for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def words(text: Column) -> Column:
    """How many runs of characters other than space and U+0009 to U+000D a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")
