"""Centroid clustering of integer vectors: float32 screening with error intervals, exact integers where they overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick, table

#: A component becomes floor(SCALE * x).
SCALE = 256
#: Vectors whose distances are screened at a time.
BLOCK = 4096
#: Sums travel in pieces of so many bits, so 2^39 vectors can be added up in 64 bits.
PIECE = 24
#: Integers below this bound are subtracted, squared and added up over 64 components (4,096 at most for the next) in 64 bits.
NARROW = 2**25
#: Unit roundoff of float32.
UNIT = 2.0**-24
LONGS = range(-(2**63), 2**63)


def integers(column: pa.ListArray, dimension: int) -> np.ndarray:
    """floor(SCALE * x) of every component: int64, or Python integers where one needs more than 62 bits."""
    flat = column.flatten()
    x = np.floor(SCALE * np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)).reshape(-1, dimension)
    if np.isfinite(x).all() and (not x.size or np.abs(x).max() < 2.0**62):
        return x.astype(np.int64)
    # SCALE * x may leave the range of doubles, so a power of two is put back after the floor of x's own integer ratio
    whole = [v.as_integer_ratio() for v in np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).tolist()]
    return np.array([SCALE * a // b for a, b in whole], object).reshape(-1, dimension)


class Assigner:
    """The nearest of some integer centroids for each of many integer vectors; ties go to the smaller number.

    A distance is |v|^2 - 2 v.c + |c|^2, of which |v|^2 is common to all. v.c comes from one float32 product of matrices.
    Whatever the order of its additions, it errs by at most g |v| |c| with g = n u / (1 - n u), n the dimension and two
    roundings of the factors; so each centroid's value lies in an interval. Where other intervals reach below the least
    upper end, those centroids' distances are computed in integers, and the least of these wins.
    """

    def __init__(self, centroids: list[list[int]]) -> None:
        self.exact = np.array(centroids, object)
        self.narrow = all(abs(x) < NARROW for c in centroids for x in c)
        self.whole = self.exact.astype(np.int64) if self.narrow else self.exact
        n = self.exact.shape[1] + 2
        self.gamma = 1.01 * n * UNIT / (1 - n * UNIT)
        if self.narrow:
            self.single = self.whole.astype(np.float32)
            self.squares = (self.whole * self.whole).sum(axis=1).astype(np.float64)
            self.lengths = np.sqrt(self.squares)

    def shortlist(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, centroid): whether the interval of the centroid reaches below every other's upper end."""
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        products = (vectors.astype(np.float32) @ self.single.T).astype(np.float64)
        value = self.squares[None, :] - 2 * products
        # what the doubles of this line and the last err by is far below one part in 2^40 of these magnitudes
        error = 2 * self.gamma * lengths[:, None] * self.lengths[None, :] + 2.0**-40 * (self.squares[None, :] + 2 * lengths[:, None] * self.lengths[None, :])
        return value - error <= (value + error).min(axis=1, keepdims=True)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid numbers, exact squared distances) of the rows of vectors."""
        if not self.narrow or vectors.dtype == object or (vectors.size and np.abs(vectors).max() >= NARROW):
            return self._wide(vectors)
        near, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        for at in range(0, len(vectors), BLOCK):
            v = vectors[at : at + BLOCK]
            some = self.shortlist(v)
            first = some.argmax(axis=1)
            best = ((v - self.whole[first]) ** 2).sum(axis=1)
            several = np.flatnonzero(some.sum(axis=1) > 1)
            rows, which = np.nonzero(some[several])
            exact = np.full((len(several), len(self.whole)), np.iinfo(np.int64).max)
            exact[rows, which] = ((v[several[rows]] - self.whole[which]) ** 2).sum(axis=1)
            first[several] = exact.argmin(axis=1)  # the first of equals
            best[several] = exact.min(axis=1)
            near[at : at + BLOCK], distance[at : at + BLOCK] = first, best
        return near, distance

    def _wide(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for numbers of any size, in Python's integers."""
        near, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), object)
        for i, v in enumerate(vectors):
            all_ = ((self.exact - v.astype(object)) ** 2).sum(axis=1).tolist()
            distance[i] = min(all_)
            near[i] = all_.index(distance[i])
        return near, distance


def _pieces(total: int, pieces: int) -> list[int]:
    """total as signed digits to the base 2^PIECE, lowest first; the last takes what is left."""
    out = []
    for _ in range(pieces - 1):
        out.append(total & ((1 << PIECE) - 1))
        total >>= PIECE
    return [*out, total]


def _sums(centroids: list[list[int]], pieces: int):
    dimension = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids)
        counts = [0] * len(centroids)
        sums = [[0] * (dimension * pieces) for _ in centroids]
        for batch in batches:
            vectors = integers(batch.column(1), dimension)
            near, _ = assigner.assign(vectors)
            for k in np.unique(near).tolist():
                own = vectors[near == k]
                counts[k] += len(own)
                rest = own
                for p in range(pieces):
                    digit = rest if p == pieces - 1 else rest & ((1 << PIECE) - 1)
                    for j, s in enumerate(digit.sum(axis=0).tolist()):
                        sums[k][j * pieces + p] += s
                    rest = rest >> PIECE
        used = [k for k, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k in used for _ in sums[k]], pa.int32()), pa.array([j for k in used for j in range(len(sums[k]))], pa.int32()), pa.array([counts[k] for k in used for _ in sums[k]], pa.int64()), pa.array([s for k in used for s in sums[k]], pa.int64())],
            ["cluster", "place", "n", "total"],
        )

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids)
        for batch in batches:
            near, distance = assigner.assign(integers(batch.column(1), len(centroids[0])))
            fits = [d if d in LONGS else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Kept are vectors of exactly `dimension` components, none null or non-finite, as integers floor(256 * x). The first
    centroids are the vectors whose lowercase hexadecimal SHA-256 of "<seed>:<id>" is smallest; of rows that share an id
    the one with the smaller vector comes first, and rows with a null id come last. Each round assigns all vectors to the nearest centroid
    (ties: the smaller number) and moves every non-empty centroid to the floor of its vectors' mean. With fewer vectors
    than clusters there are fewer clusters. Rows that repeat an id are vectors of their own; null ids stay null. Sums
    are exact whatever the components' size; a distance or inertia beyond 64 bits is null. Other columns are ignored; an empty table
    gives no rows.

    A round is one pass over the vectors. A task sends one row for each cluster and component (sums and counts), Spark
    adds them up, and the driver gets `clusters` times `dimension` numbers, whatever the input.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id_col, vector=vector_col).where("vector IS NOT NULL").where(F.size("vector") == dimension)
    kept = rows.where(F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))
    kind = dict(kept.dtypes)["vec_id"]
    by_hash = kept.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    top = by_hash.orderBy(F.asc_nulls_last("_hash"), "vector").limit(clusters).select("vector").toArrow().column("vector").combine_chunks()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(top):
        return spark.createDataFrame([], schema)
    centroids = [[int(x) for x in v] for v in integers(top, dimension)]
    largest = kept.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()[0]
    pieces = 1 + (int(largest) * SCALE + SCALE).bit_length() // PIECE
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(centroids, pieces), "cluster int, place int, n long, total long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        moved = [[0] * dimension for _ in centroids]
        counts = [0] * len(centroids)
        for r in sums.collect():  # clusters x dimension x pieces numbers
            j, p = divmod(r["place"], pieces)
            counts[r["cluster"]] = r["n"]
            moved[r["cluster"]][j] += r["total"] << (PIECE * p)
        centroids = [[s // n for s in total] if n else old for total, n, old in zip(moved, counts, centroids)]
    found = materialise(kept.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long"))
    whole = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("wide")).collect()  # a row a cluster
    inertia = {r["cluster"]: None if r["wide"] else int(r["s"]) for r in whole}
    total = None if None in inertia.values() else sum(inertia.values())
    fits = lambda x: x if x is not None and x in LONGS else None
    facts = [(k, fits(own), fits(total), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, own in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(rounds: int = 5, clusters: int = 40, dimension: int = 64) -> str:
    floor = "(s - ((s % n) + n) % n) // n"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension}),
parts AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range({dimension})) AS j FROM kept),
c0 AS MATERIALIZED (
  SELECT k, unnest(v) AS x, unnest(range({dimension})) AS j
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {clusters})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS MATERIALIZED (SELECT p.row, c.k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM parts p JOIN c{r} c USING (j) GROUP BY p.row, c.k),
a{r} AS MATERIALIZED (SELECT row, k, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, k) AS n FROM d{r}) WHERE n = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN parts USING (row) GROUP BY k, j),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce({floor}, c.x) AS x, c.j FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.j = c.j)"""
            )
    return f"""WITH {", ".join(steps)},
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN named USING (k)"""


#: DuckDB SQL of the query's rows.
ORACLE = _oracle()
