"""The trie of conversations' prefixes, with sums over subtrees by heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.operators.numbering import ordinal

from .common import materialise, pick, table

#: Nodes of one path array; longer paths are several.
PATH = 512
#: Identifiers that lie in one block of so many numbers travel as one string.
IDS = 4096
#: Conversations c - c % FAMILY give up to SHARED - 1 turns to conversation c.
FAMILY, SHARED = 100, 6


def _key(*parts: str) -> Column:
    """A prefix of the sums in parts and the depth, as 16 bytes."""
    return F.unhex(F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]).cast("binary")))


def in_order(turns: DataFrame) -> DataFrame:
    """(conv, pos, one, two, chars) from (conv, turn, role, text): places from 1 by turn (null first), role, text.

    one and two are 64 bits each of the SHA-256 of role and text. The table is sorted in ranges between sampled quantiles,
    so a conversation that holds most rows is cut, too.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.select("conv", "turn", role.alias("role"), text.alias("text"), said.alias("said"), F.length(text).cast("long").alias("chars"))
    numbered = materialise(ordinal(rows, ["conv", "turn", "role", "text"], "at").select("conv", "at", "said", "chars"))
    first = numbered.groupBy("conv").agg(F.min("at").alias("first"))
    half = lambda i: F.xxhash64(F.substring("said", i, 32))
    return numbered.join(first, "conv").select("conv", (F.col("at") - F.col("first") + 1).alias("pos"), half(1).alias("one"), half(33).alias("two"), "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs: conv, n) and (turns: conv, pos, one, two, chars) of the rebuilt conversations.

    h is crc32(conv) % 6. A conversation takes the first h turns of the first one of its hundred, then its own after the
    h-th. A donor gives five rows at most to each of its hundred (two hundred around 0), whose ids are distinct.
    """
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    donors = sizes.select(F.col("conv").alias("donor"), F.col("own").alias("given"))
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(SHARED))
    planned = sizes.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("donor")).join(donors, "donor", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    plan = materialise(planned.select("conv", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    head = own.where(F.col("pos") < SHARED).withColumnRenamed("conv", "donor").join(plan.select("conv", "donor", "taken").where("taken > 0"), "donor").where(F.col("pos") <= F.col("taken"))
    tail = own.join(plan.select("conv", "h", "taken"), "conv").where(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "one", "two", "chars"]
    return plan.select("conv", "n"), head.select(*columns).unionByName(tail.select(*columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, chars): the prefix that ends in each turn, and the one before.

    A turn's two numbers are hashed with its place, and a prefix is the exact sums of these; so the prefixes of a long
    conversation are running sums over its blocks of PATH turns, not one chain. The key hashes the two sums and the depth.
    """
    hashed = turns.select("conv", "pos", "chars", ((F.col("pos") - 1) / PATH).cast("long").alias("block"), *[F.xxhash64("pos", c, F.lit(seed)).cast("decimal(38,0)").alias(c) for seed, c in enumerate(("one", "two"))])
    hashed = materialise(hashed)
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.sum(c).over(w).cast("decimal(38,0)")
    none = F.lit(0).cast("decimal(38,0)")
    long_ones = hashed.where("block > 0").select("conv").distinct()
    blocks = hashed.join(long_ones, "conv", "left_semi").groupBy("conv", "block").agg(F.sum("one").cast("decimal(38,0)").alias("one"), F.sum("two").cast("decimal(38,0)").alias("two"))
    before = blocks.select("conv", "block", F.coalesce(summed("one", earlier), none).alias("one0"), F.coalesce(summed("two", earlier), none).alias("two0"))
    local = hashed.select("conv", "block", "pos", "chars", F.col("one").alias("own1"), F.col("two").alias("own2"), summed("one", inside).alias("one"), summed("two", inside).alias("two"))
    at = local.join(before, ["conv", "block"], "left").select("conv", "pos", "chars", "own1", "own2", *[(F.col(c) + F.coalesce(F.col(f"{c}0"), none)).cast("decimal(38,0)").alias(c) for c in ("one", "two")])
    last = at.select("conv", "chars", "pos", "one", "two", (F.col("pos") - 1).alias("pos0"), (F.col("one") - F.col("own1")).cast("decimal(38,0)").alias("one0"), (F.col("two") - F.col("own2")).cast("decimal(38,0)").alias("two0"))
    return last.select("conv", F.col("pos").cast("long").alias("depth"), _key("one", "two", "pos").alias("key"), _key("one0", "two0", "pos0").alias("parent"), "chars")


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """nodes (key, parent, depth, n, conv) with head and level: the top of each node's heavy path, and light edges above it.

    A node's heavy child is that with most members (ties: the smallest member), so a light child has at most half of its
    parent's members, and a node has log2(members) light edges above it at most. Jumps along heavy edges double, so a path of m nodes
    takes log2(m) joins by unique keys; levels then go down from the root's path.
    """
    rank = F.struct("n", (-F.col("conv")).alias("c"))
    heavy = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.max_by("key", rank).alias("child")).select(F.col("child").alias("key"), F.lit(True).alias("heavy"))
    jump = materialise(nodes.join(heavy, "key", "left").select("key", "parent", F.col("heavy").isNotNull().alias("heavy")))
    open_ = jump.where("heavy").select("key", F.col("parent").alias("up"))
    done = [jump.where("NOT heavy").select("key", F.col("key").alias("head"))]
    while open_.take(1):
        met = done[0].select(F.col("key").alias("up"), "head") if len(done) == 1 else reduce(DataFrame.unionByName, done).select(F.col("key").alias("up"), "head")
        further = open_.select(F.col("key").alias("up"), F.col("up").alias("next"))
        step = materialise(open_.join(met, "up", "left").join(further, "up", "left").select("key", "head", F.col("next").alias("up")))
        done.append(step.where("head IS NOT NULL").select("key", "head"))
        open_ = step.where("head IS NULL").select("key", "up")
    heads = materialise(reduce(DataFrame.unionByName, done))
    above = heads.select(F.col("key").alias("parent"), F.col("head").alias("upper"))
    paths = materialise(jump.where("NOT heavy").select(F.col("key").alias("head"), "parent").join(above, "parent", "left").select("head", "upper"))
    levels = [materialise(paths.where("upper IS NULL").select("head", F.lit(0).alias("level")))]
    while levels[-1].take(1):
        upper = levels[-1].select(F.col("head").alias("upper"))
        levels.append(materialise(paths.join(upper, "upper").select("head", F.lit(len(levels)).alias("level"))))
    return nodes.join(heads, "key").join(reduce(DataFrame.unionByName, levels), "head")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(key, *values): sums over each node's subtree, the node included. nodes: key, parent, depth, head, level, *values.

    Level by level from the deepest: what the light paths below hang on a node is added to its own value, and sums run from the
    foot of each path up, in arrays of PATH nodes, to which the sums of the arrays below are added.
    """
    nodes = materialise(nodes.select("key", "parent", "depth", "head", "level", *values))
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return nodes.select("key", *values)
    hung, out = None, []
    down = Window.partitionBy("head").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    for level in range(deepest, -1, -1):
        own = nodes.where(F.col("level") == level)
        if hung is not None:
            added = hung.groupBy("parent").agg(*[F.sum(v).alias(f"_{v}") for v in values]).withColumnRenamed("parent", "key")
            own = own.join(added, "key", "left").select("key", "parent", "depth", "head", *[(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])
        pieces = own.groupBy("head", (F.col("depth") / PATH).cast("long").alias("piece")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "key", "parent", *values)))).alias("path"))
        total = lambda v: F.aggregate(F.col(f"path.{v}"), F.lit(0).cast("long"), lambda a, x: a + x)
        pieces = pieces.select("head", "path", *[F.coalesce(F.sum(total(v)).over(down), F.lit(0)).alias(f"_{v}") for v in values])
        start = F.struct(F.array().cast("array<struct<key:binary,parent:binary," + ",".join(f"{v}:bigint" for v in values) + ">>").alias("done"), *[F.col(f"_{v}").cast("long").alias(v) for v in values])

        def add(acc: Column, x: Column) -> Column:
            now = [(acc[v] + x[v]).alias(v) for v in values]
            return F.struct(F.array_append(acc["done"], F.struct(x["key"].alias("key"), x["parent"].alias("parent"), *now)).alias("done"), *now)

        summed = pieces.select("head", F.inline(F.aggregate("path", start, add)["done"]))
        out.append(materialise(summed))
        hung = out[-1].where(F.col("key") == F.col("head")).where("parent IS NOT NULL")
    return reduce(DataFrame.unionByName, out).select("key", *values)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's strings, which come in order and joined by commas: only a running state is kept."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv): ids ascending, comma-joined. Blocks of ids are joined first, then streamed in order."""
    block = F.floor(F.col("conv") / IDS).cast("long")
    joined = ends.groupBy("key", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    return joined.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations: one row a node, as conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first; equal numbers by role, then text, and rows that repeat all of these are turns of
    their own. Null roles and texts are empty. Rows with a null conversation are left out. An empty table has no
    conversation and so no node, not even the root. Other columns are ignored. Two different prefixes count as one only
    if 128 bits of their hashes agree.

    Nothing gathers a conversation, a node's members or children in one task: turns are numbered in sampled ranges,
    members are counted on the map side, long paths are cut, and ids are hashed from a stream of sorted blocks.
    """
    rows = pick(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv IS NOT NULL").withColumn("conv", F.col("conv").cast("long"))
    own = materialise(in_order(rows))
    convs, whole = rebuilt(own)
    steps = materialise(prefixes(whole))
    zero = F.lit(0).cast("decimal(38,0)")
    at_root = convs.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("one"), zero.alias("two")).select("conv", "depth", _key("one", "two", "depth").alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    members = at_root.unionByName(steps.select("conv", "depth", "key", "parent", "chars"))
    nodes = materialise(members.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("children")).withColumnRenamed("parent", "key")
    nodes = materialise(nodes.join(children, "key", "left").withColumn("children", F.coalesce("children", F.lit(0))))
    valued = heavy_paths(nodes).withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars"))
    sums = subtree_sums(valued, ["leaves", "saved"])
    ends = members.join(convs.select("conv", F.col("n").alias("depth")), ["conv", "depth"], "left_semi").select("key", "conv")
    digests = end_digests(ends)
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    whole = nodes.join(sums, "key").join(digests, "key", "left").join(parents, "parent", "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: DuckDB SQL of the query's rows; crc32 is written out, bit by bit.
ORACLE = """
WITH turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT c, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT)) AS b FROM (SELECT DISTINCT c FROM turns)),
convs AS MATERIALIZED (
  SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda r, x:
    list_reduce(list_prepend(xor(r, x), CAST(range(8) AS BIGINT[])), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))) % 6 AS h
  FROM bytes),
chosen AS (
  SELECT v.c, 0 AS part, t.pos, said, chars FROM convs v JOIN turns t ON t.c = v.base AND t.pos <= v.h
  UNION ALL SELECT v.c, 1, t.pos, said, chars FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
placed AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, said, chars FROM chosen),
grown AS MATERIALIZED (SELECT c, d, chars, string_agg(sha256(said), '') OVER (PARTITION BY c ORDER BY d) AS p FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lasts AS (SELECT c, max(d) AS d FROM grown GROUP BY c),
nodes AS MATERIALIZED (SELECT p, d, min(chars) AS chars, min(c) AS conv_id, count(*) AS n FROM grown GROUP BY p, d),
ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM grown JOIN lasts USING (c, d) GROUP BY p),
kids AS MATERIALIZED (SELECT substr(p, 1, CAST((d - 1) * 64 AS INT)) AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
valued AS MATERIALIZED (SELECT p, d, (n - 1) * chars AS saved, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes LEFT JOIN kids USING (p)),
below AS (
  SELECT substr(p, 1, CAST(u * 64 AS INT)) AS p, sum(saved) AS saved, sum(leaf) AS leaves
  FROM (SELECT p, saved, leaf, unnest(range(d + 1)) AS u FROM valued) GROUP BY 1)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(k, 0) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes m JOIN below b USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p)
LEFT JOIN nodes q ON m.d > 0 AND q.p = substr(m.p, 1, CAST((m.d - 1) * 64 AS INT))
"""
