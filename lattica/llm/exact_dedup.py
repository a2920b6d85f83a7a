"""Exact duplicates by an extendible-hash index in shared files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_KEYS, attach, materialise, pick, table


def _prefix(key: Column, depth: int) -> Column:
    """The directory slot of a key: its first bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Global depth and the buckets (first slot, last slot, local depth) of distinct 64-bit keys.

    The directory starts at the depth that an even spread needs and doubles while a bucket holds more than
    capacity keys; only overfull buckets split. Keys are distinct, so a bucket holds one key at depth 64 at
    the latest. The driver holds counts of buckets, about 2 * keys / capacity numbers.
    """
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / capacity)))

    def filled(depth: int) -> dict[int, int]:
        return {r["slot"]: r["count"] for r in keys.groupBy(_prefix(F.col("key"), depth).alias("slot")).count().collect()}

    done: list[tuple[int, int]] = []
    counts = filled(depth)
    candidates = range(2**depth)
    while True:
        overfull = [s for s in candidates if counts.get(s, 0) > capacity]
        done += [(s, depth) for s in candidates if counts.get(s, 0) <= capacity]
        if not overfull or depth == 64:
            done += [(s, depth) for s in overfull]
            break
        depth += 1
        candidates = [child for s in overfull for child in (2 * s, 2 * s + 1)]
        counts = filled(depth)
    return depth, sorted((s << (depth - d), ((s + 1) << (depth - d)) - 1, d) for s, d in done)


def _bucket_of(spark: SparkSession, rows: DataFrame, depth: int, buckets: list[tuple[int, int, int]]) -> DataFrame:
    """Look the key's bucket up at every local depth in use; the directory has a proven size and is broadcast."""
    depths = sorted({d for _, _, d in buckets})
    directory = spark.createDataFrame([(n, d, first >> (depth - d)) for n, (first, _, d) in enumerate(buckets)], "bucket int, _d int, _p long")
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _prefix(F.col("key"), d).alias("p")) for d in depths]))
    probes = rows.withColumn("_at", at).withColumn("_d", F.col("_at.d")).withColumn("_p", F.col("_at.p")).drop("_at")
    return probes.join(F.broadcast(directory), ["_d", "_p"]).drop("_d", "_p")


def exact_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 100_000, key_bits: int = 64, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of a group the largest id stays. Rows
    that repeat an id and a text are one document: they count in group_size and share its verdict. A null id
    never wins over another; in a group of null ids only, all stay. Empty tables give no rows, and other
    columns are ignored. 64-bit keys may collide (key_bits makes them shorter, for tests): a key's chain then
    has several entries, told apart by their bytes.

    Method: one scan makes the keys and counts them; they go to shared files. An extendible directory over the
    keys' first bits assigns key ranges to buckets, and so to owner tasks. Texts whose key repeats are grouped
    by key and bytes with map-side combination, so a group of a third of all rows is one row a task; owners
    number each key's chain and write the index. A last scan attaches the index to the rows.
    """
    spark = docs.sparkSession
    mask = -1 << (64 - key_bits) if key_bits < 64 else -1
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", F.xxhash64("text").bitwiseAND(F.lit(mask).cast("long")))

    keys = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    repeated = keys.where("n > 1").select("key")
    total, n_repeated = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    depth, buckets = build_directory(keys, bucket_capacity)

    again = rows.join(F.broadcast(repeated), "key", "left_semi") if n_repeated <= broadcast_keys else rows
    entries = again.groupBy("key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    if n_repeated > broadcast_keys:  # all texts were grouped: entries of keys that occur once need no index
        entries = entries.join(repeated, "key", "left_semi")
    owned = _bucket_of(spark, entries.select("key", F.sha2("text", 256).alias("sha"), "keep_id", "group_size"), depth, buckets)
    chain = Window.partitionBy("bucket", "key")
    owned = owned.repartition(F.col("bucket")).withColumn("chain_length", F.count(F.lit(1)).over(chain))
    index = materialise(owned.withColumn("chain_no", F.row_number().over(chain.orderBy("sha"))))

    single = index.where("chain_length = 1").select("key", "keep_id", "group_size")
    n_chained = index.where("chain_length > 1").count()
    slim = rows.select("id", "key", F.sha2("text", 256).alias("sha"))
    if n_chained == 0:
        out = attach(slim, single, "key", "group_size", total, n_repeated, F.col("id"), broadcast_keys)
    else:
        # keys that collide: their rows meet the chain's entries by bytes
        collided = index.where("chain_length > 1").select("key").distinct()
        small = n_chained <= broadcast_keys
        collided = F.broadcast(collided) if small else collided
        texts = rows.join(collided, "key", "left_semi")
        groups = texts.groupBy("key", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        met = texts.join(groups, ["key", "text"]).select("id", "key", F.sha2("text", 256).alias("sha"), "keep_id", "group_size")
        plain = slim.join(collided, "key", "left_anti")
        out = attach(plain, single, "key", "group_size", total, n_repeated, F.col("id"), broadcast_keys).unionByName(met)
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
