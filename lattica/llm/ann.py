"""Approximate nearest neighbours: balanced posting lists, a graph over their centroids, distance-ratio pruning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, pick, table

#: The index is fitted on a seeded sample of so many vectors at most, on the driver; every vector is indexed.
SAMPLE = 20_000
#: Vectors a list has on average before replication, and lists at most (their centroids go to every task).
LIST, LISTS = 400, 2048
#: A vector goes to up to REPLICAS lists whose centroids are at most 1 + BOUNDARY times as far as the nearest.
REPLICAS, BOUNDARY = 4, 0.15
#: Share of the true neighbours, in the sample, that the pruning ratio must leave in reach.
REACH = 0.98
#: Neighbours in the centroid graph, nodes that a step expands; vectors and queries that meet in one block at most.
DEGREE, EXPAND, BLOCK, QUERIES = 16, 4, 1024, 512
#: A query looks into lists of so many vectors together at least, and into WIDER times as many while it has too few neighbours.
LEAST, WIDER = 64, 8
#: More than a product of matrices in double precision errs by in a cosine.
ROUGH = 1e-9


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    ratio: float = 1.0
    probes: int = 1

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the lists nearest to it and their distances, beam of them, by best-first search in the graph.

        A search ends when the nearest node that isn't expanded is further than the beam's last. Vectors go in batches:
        a step gathers EXPAND nodes' neighbours for each of them.
        """
        found = [self._search(vectors[i : i + BLOCK], beam) for i in range(0, len(vectors), BLOCK)]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(vectors), len(self.centroids)
        beam = min(beam, k)
        rows = np.arange(n)
        near = np.full((n, k), np.inf, np.float32)
        open_ = np.full((n, k), np.inf, np.float32)
        first = _distances(vectors, self.centroids[self.entries])
        near[:, self.entries] = open_[:, self.entries] = first
        live = rows
        while len(live):
            some = min(EXPAND, k)
            pick_ = np.argpartition(open_[live], some - 1, axis=1)[:, :some]
            far = np.partition(near[live], beam - 1, axis=1)[:, beam - 1]
            good = (np.take_along_axis(open_[live], pick_, 1) <= far[:, None]) & np.isfinite(np.take_along_axis(open_[live], pick_, 1))
            live, pick_, good = live[good.any(1)], pick_[good.any(1)], good[good.any(1)]
            if not len(live):
                break
            at, which = np.nonzero(good)
            owner, node = live[at], pick_[at, which]
            open_[owner, node] = np.inf
            owner, node = np.repeat(owner, self.graph.shape[1]), self.graph[node].reshape(-1)
            new = ~np.isfinite(near[owner, node])
            owner, node = owner[new], node[new]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", vectors[owner], self.centroids[node])))
            near[owner, node] = open_[owner, node] = d
        best = np.argpartition(near, beam - 1, axis=1)[:, :beam]
        d = np.take_along_axis(near, best, 1)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(d, order, 1)

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that hold each vector."""
        lists, d = self.search(vectors, 2 * REPLICAS)
        near = (d <= (1 + BOUNDARY) * d[:, :1] + 1e-6) & np.isfinite(d)
        near[:, REPLICAS:] = False
        at, which = np.nonzero(near)
        return at, lists[at, which]

    def probed(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists to look into: those within the ratio of the nearest, and more until least is met."""
        lists, d = self.search(vectors, 2 * self.probes)
        wanted = (d <= self.ratio * d[:, :1] + 1e-6) & np.isfinite(d)
        short = np.flatnonzero(np.where(wanted, sizes[lists], 0).sum(1) < min(least, int(sizes.sum())))
        at, which = np.nonzero(wanted)
        out = [(at, lists[at, which])]
        if len(short):
            full = np.argsort(_distances(vectors[short], self.centroids), axis=1, kind="stable")
            before = np.cumsum(sizes[full], axis=1) - sizes[full]
            at, which = np.nonzero(before < least)
            out.append((short[at], full[at, which]))
        pairs = np.unique(np.stack([np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so lengths don't overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return _directions(vectors).astype(np.float32)


def fit(sample: np.ndarray, lists: int, near: int) -> Index:
    """Balanced k-means (fuller lists look further away), a graph of nearest centroids, and the pruning ratio.

    The ratio is the least that leaves REACH of the sample's true neighbours in lists that a query looks into.
    """
    rng = np.random.Generator(np.random.PCG64(11))
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    penalty = np.zeros(lists, np.float32)
    for step in range(12):
        home = np.argmin(_distances(sample, centroids) + penalty, axis=1)
        sizes = np.bincount(home, minlength=lists)
        penalty = (0.1 * np.clip(sizes / (len(sample) / lists) - 1, -1, 3) * min(1, step / 6)).astype(np.float32)
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, home, sample)
        lengths = np.linalg.norm(sums, axis=1)
        centroids = np.where((lengths > 1e-9)[:, None], sums / np.maximum(lengths, 1e-9)[:, None], centroids).astype(np.float32)
    degree = min(DEGREE, lists)
    nearest = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")[:, :degree]
    graph = np.concatenate([nearest, rng.integers(0, lists, (lists, 8))], axis=1)  # a few long edges keep it connected
    index = Index(centroids, graph, rng.choice(lists, min(lists, 16), replace=False))

    at, which = index.homes(sample)
    holds: list[list[int]] = [[] for _ in sample]
    for i, k in zip(at.tolist(), which.tolist()):
        holds[i].append(k)
    asked = rng.choice(len(sample), min(512, len(sample)), replace=False)
    ratios, counts = [], []
    to_centroids = np.sort(_distances(sample[asked], centroids), axis=1)
    for i, row, d in zip(asked.tolist(), sample[asked] @ sample.T, _distances(sample[asked], centroids)):
        row[i] = -np.inf
        for j in np.argsort(-row)[: min(near, len(sample) - 1)].tolist():
            ratios.append(min(d[k] for k in holds[j]) / max(d.min(), 1e-6))
    index.ratio = float(np.quantile(ratios, REACH)) if ratios else 1.0
    counts = (to_centroids <= index.ratio * to_centroids[:, :1] + 1e-6).sum(axis=1)
    index.probes = int(counts.max())
    return index


def _usable(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whether a row holds a usable vector, its length, where it begins among all numbers, all numbers in double precision)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    starts = np.cumsum(lengths) - lengths
    good, some = np.zeros(len(lengths), bool), lengths > 0
    if some.any():
        finite = np.logical_and.reduceat(np.isfinite(numbers), starts[some])
        good[some] = finite & np.logical_or.reduceat(numbers != 0, starts[some])
    return good, lengths, starts, numbers


def _vectors(column: pa.Array | pa.ChunkedArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a usable vector of the dimension, and these vectors in double precision."""
    good, lengths, starts, numbers = _usable(column)
    rows = np.flatnonzero(good & (lengths == dimension))
    return rows, numbers[starts[rows][:, None] + np.arange(dimension)]


def _posted(index: Index, dimension: int, columns: tuple[str, str], sizes: np.ndarray | None = None, least: int = LEAST):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, vectors = _vectors(part.column(1), dimension)
                if not len(rows):
                    continue
                units = _unit(vectors)
                which, lists = index.homes(units) if sizes is None else index.probed(units, sizes, least)
                take = pa.array(rows[which])
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column(0).take(take), part.column(1).take(take)], ["list", *columns])

    return run


def _meet(top: int, dimension: int):
    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            v = _vectors(vectors.column("vector"), dimension)[1][order]
            q = _vectors(queries.column("vector"), dimension)[1]
            asked = queries.column("query_id").to_numpy()
            ids, first = np.unique(ids, return_index=True)
            owner = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(v))))
            rough = np.maximum.reduceat(_directions(q) @ _directions(v).T, first, axis=1)  # the best of the rows that share an id
            rough[asked[:, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, max(0, len(ids) - top), axis=1)[:, max(0, len(ids) - top)] - ROUGH
            for i, query in enumerate(asked.tolist()):
                # ids that rounding may bring among the best are measured exactly; equal scores keep the smaller ids
                rows = np.flatnonzero(((rough[i] >= least[i]) & (rough[i] > -np.inf))[owner])
                if len(rows):
                    chosen, first = np.unique(owner[rows], return_index=True)
                    exact = np.maximum.reduceat(cosines(q[i : i + 1], v[rows])[0], first)
                    found += [(query, int(ids[chosen[j]]), float(exact[j])) for j in np.argsort(-exact, kind="stable")[:top]]
        return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each from the products of its own pair, so a block's shape doesn't change it."""
    top_a, top_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    a = np.where((top_a > 1e100) | (top_a < 1e-100), a / top_a, a)
    b = np.where((top_b > 1e100) | (top_b < 1e-100), b / top_b, b)
    lengths = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    return np.stack([(b * x).sum(axis=1) for x in a]) / lengths


def nearest_neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by every, the top other ids by cosine.

    Vectors that are null, empty or zero, or hold nulls or non-finite numbers, take no part; nor do those of another
    dimension than most of the sample (of equally many the smallest) or with a null id. Scores are cosines of the
    original vectors in double precision; equal ones go by the smaller id. Rows that repeat an id are one candidate,
    with the best score of them, and one query. A query has fewer than top rows only if there are fewer candidates.
    An empty table gives no rows; other columns are ignored.

    Method: fit() learns centroids on a bounded sample. Every vector is posted to its nearest lists, several if it is
    near a boundary; a graph search finds them, and the lists a query looks into. Long lists are cut to blocks of
    BLOCK vectors and QUERIES queries, so no list, however full, is one task.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id_col, vector=vector_col).where("vec_id IS NOT NULL AND vector IS NOT NULL").withColumn("vec_id", F.col("vec_id").cast("long"))
    kind = dict(rows.dtypes)["vector"]
    schema = "query_id long, rank int, vec_id long, score double"
    usable = rows.where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0))
    by_hash = [F.xxhash64("vec_id"), F.col("vec_id")]
    ids = usable.select("vec_id").distinct().orderBy(*by_hash).limit(SAMPLE)  # broadcast below: SAMPLE numbers at most
    sampled = usable.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(*by_hash).toArrow().column("vector").combine_chunks()
    good, lengths, _, _ = _usable(sampled)
    dimensions = Counter(lengths[good].tolist())
    if not dimensions:
        return spark.createDataFrame([], schema)
    dimension = min(dimensions, key=lambda d: (-dimensions[d], d))
    sample = _unit(_vectors(sampled, dimension)[1])
    index = fit(sample, min(LISTS, -(-rows.count() // LIST)), top)

    posted = materialise(rows.mapInArrow(_posted(index, dimension, ("vec_id", "vector")), f"list int, vec_id long, vector {kind}"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in posted.groupBy("list").count().collect():  # a row for each list
        sizes[r["list"]] = r["count"]
    asking = rows.where(F.col("vec_id") % every == 0)
    best, least = [], LEAST
    while True:
        asked = materialise(asking.mapInArrow(_posted(index, dimension, ("query_id", "vector"), sizes, least), f"list int, query_id long, vector {kind}"))
        best.append(materialise(_best(posted, asked, sizes, top, dimension)))
        filled = best[-1].groupBy("query_id").count().where(F.col("count") >= top)
        if least >= sizes.sum() or not (short := asked.join(filled, "query_id", "left_anti").select("query_id").distinct()).take(1):
            break
        # too few distinct ids in the lists that they have read, so these queries read more, all lists in the end
        short = materialise(short)
        best[-1] = best[-1].join(short, "query_id", "left_anti")
        asking = asking.join(short.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_semi")
        least *= WIDER
    return reduce(DataFrame.unionByName, best).select("query_id", "rank", "vec_id", "score")


def _best(posted: DataFrame, asked: DataFrame, sizes: np.ndarray, top: int, dimension: int) -> DataFrame:
    """query_id, vec_id, score, rank: the nearest of what is in the lists that each query looks into."""
    asked_of = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row for each list
    cut = [(k, max(1, -(-int(sizes[k]) // BLOCK)), -(-n // QUERIES)) for k, n in asked_of.items()]
    cuts = F.broadcast(posted.sparkSession.createDataFrame(cut, "list int, parts int, turns int"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod(F.col("_n"), F.col(n)).cast("int")  # noqa: E731  # by place in the written table: repeated rows are spread, too
    left, right = (side.withColumn("_n", F.monotonically_increasing_id()).join(cuts, "list") for side in (posted, asked))
    left = left.select("list", share("parts").alias("part"), span("turns").alias("turn"), "vec_id", "vector")
    right = right.select("list", span("parts").alias("part"), share("turns").alias("turn"), "query_id", "vector")
    keys = ["list", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(top, dimension), "query_id long, vec_id long, score double")
    pairs = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def op1_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
