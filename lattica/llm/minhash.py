"""Near duplicates by one-permutation MinHash with optimal densification, bands and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, attach, materialise, pick, release, table
from .graph import components
from .shingles import mix, shingle_sets

#: 128 bins in 32 bands of 4: two sets of similarity 0.8 share no band with probability 5e-8, of 0.85 with 6e-11.
BINS, ROWS = 128, 4
#: Members of an unresolved family that meet in one block.
CHUNK = 256


def _probes(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others while it is empty: a seeded permutation, so it always ends."""
    rng = np.random.Generator(np.random.PCG64(77))
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each range of hashes; empty bins take that of the first full one they probe."""
    bits = np.uint64(64 - (bins.bit_length() - 1))
    values, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = s >> bits
        firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(s) else np.zeros(0, int)
        values[i, at[firsts]], full[i, at[firsts]] = s[firsts], True
    out, done, probes = values.copy(), full.copy(), _probes(bins)
    for k in range(bins):
        rest = np.flatnonzero(~done.all(axis=1) & full.any(axis=1))
        if not len(rest):
            break
        found = full[rest][:, probes[:, k]] & ~done[rest]
        out[rest] = np.where(found, values[rest][:, probes[:, k]], out[rest])
        done[rest] |= found
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, different for each band's number."""
    bands = signature.reshape(len(signature), -1, rows)
    odd = np.array([2 * k + 0x9E3779B97F4A7C15 for k in range(rows)], np.uint64) * np.array([3**k for k in range(rows)], np.uint64)
    summed = (mix(bands + np.uint64(1)) * odd).sum(axis=2, dtype=np.uint64)
    return mix(summed + mix(np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(12345)))


def _sketch(width: int):
    schema = "id long, text_key long, n_shingles long, digest binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, counts, digests, bands = batch.column(0), [], [], [], []

            def flush() -> None:
                if sets:
                    bands.append(band_keys(signatures(sets)))
                    sets.clear()

            for s in shingle_sets(batch.column(2), width):
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sets.append(s)
                if len(sets) == 512:
                    flush()
            flush()
            keys = np.concatenate(bands) if bands else np.zeros((0, BINS // ROWS), np.uint64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BINS // ROWS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), flat], ["id", "text_key", "n_shingles", "digest", "bands"])
            release()

    return run, schema


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # few rows a batch: sets of long texts are large
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column(0), width))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], ["digest", "shingles"])
                at += 256
            release()

    return run, "digest binary, shingles array<long>"


def _meet(percent: int):
    """Links between members of a block whose components differ; of those, one for each pair of components that it joins."""

    def run(block: pa.Table) -> pa.Table:
        comps = block.column("root").to_pylist()
        digests = block.column("digest").to_pylist()
        out: list[tuple[bytes, bytes]] = []
        if len(set(comps)) > 1:
            lists = block.column("shingles").combine_chunks()
            starts = np.asarray(lists.offsets)[:-1]
            base, starts = int(starts[0]), starts - starts[0]
            flat = np.asarray(lists.values)[base:]
            flat = flat[: int(np.asarray(lists.offsets)[-1]) - base]
            _, ids = np.unique(flat, return_inverse=True)
            sizes = np.diff(np.r_[starts, len(ids)])
            parent = {c: c for c in comps}

            def find(c: bytes) -> bytes:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            often = max(parent, key=comps.count) if len(comps) < 2000 else comps[0]
            has = np.zeros(int(ids.max()) + 1, bool)
            for i in (i for i, c in enumerate(comps) if c != often):
                mine = ids[starts[i] : starts[i] + sizes[i]]
                has[mine] = True
                shared = np.add.reduceat(has[ids].astype(np.int64), starts)
                has[mine] = False
                for j in np.flatnonzero(100 * shared >= percent * (sizes + sizes[i] - shared)).tolist():
                    a, b = find(comps[i]), find(comps[j])
                    if a != b:
                        parent[a] = b
                        out.append((digests[i], digests[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, text_key (xxhash64, tells apart rows that share an id).

    Words are runs of characters other than space and U+0009 to U+000D, A-Z in lower case. A text's set holds its
    distinct shingles of width words, or a shorter text as a whole; null and wordless texts have an empty set and
    link to nothing. Texts link when 100 * common >= percent * union. component_id is the smallest id that links
    reach; the row that has it is kept. Equal sets are one class, however many rows have them, and rows that repeat
    an id share a component only if their texts link. A null id is ignored where a component has others; alone
    it is its own component and kept. Empty tables give no rows; other columns are ignored.

    Method: sets collapse to classes. Classes meet in band buckets; the member that meets most others is each
    bucket's centre, and only edges to centres are candidates, at most one a member and band. Candidates are
    confirmed on full sets. Families (classes that candidates connect) whose confirmed links leave several
    components may hold links between members that the centre missed: these families are tested exactly, in blocks
    of 2 * CHUNK members, however large they are. So a link is lost only if its texts share no band (see BINS).
    """
    rows = pick(docs, id=id_col, text=text_col)
    run, schema = _sketch(width)
    sketch = materialise(rows.select(F.col("id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))), "text").mapInArrow(run, schema))
    filled = sketch.where("n_shingles > 0")
    classes = materialise(filled.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))

    banded = classes.select("digest", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = materialise(banded.join(shared, "key").select("key", "digest", "m"))
    degree = met.groupBy("digest").agg(F.sum("m").alias("degree"))
    ranked = materialise(met.join(degree, "digest").select("key", "digest", "degree"))
    centres = ranked.groupBy("key").agg(F.max(F.struct("degree", "digest")).alias("c")).select("key", F.col("c.digest").alias("b"))
    edges = materialise(ranked.join(centres, "key").select(F.col("digest").alias("a"), "b").where("a <> b").distinct())

    ends = edges.select(F.col("a").alias("digest")).unionByName(edges.select(F.col("b").alias("digest"))).distinct()
    wanted = materialise(ends.join(classes.select("digest", "rep", "n"), "digest"))
    n_wanted = wanted.count()
    plain = n_wanted <= broadcast_keys
    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    texts = rows.join(F.broadcast(reps) if plain else reps, F.col("id").eqNullSafe(F.col("_rep")), "left_semi").select("text")
    run, schema = _sets(width)
    sets = materialise(texts.mapInArrow(run, schema))

    def sized(edges: DataFrame) -> DataFrame:
        n = wanted.select("digest", "n")
        out = edges.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
        return out.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")

    pairs = sized(edges).join(sets.toDF("a", "_sa"), "a").join(sets.toDF("b", "_sb"), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    links = materialise(pairs.where(common * 100 >= (F.size("_sa") + F.size("_sb") - common) * percent).select("a", "b"))

    family = components(edges).toDF("digest", "family")
    linked = components(links).toDF("digest", "root")
    member = materialise(family.join(linked, "digest", "left").select("digest", "family", F.coalesce("root", "digest").alias("root")))
    mixed = member.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    blocks = mixed.select("family", F.ceil(F.col("m") / CHUNK).cast("int").alias("nb"))
    chunked = member.join(blocks, "family").withColumn("_c", F.pmod(F.xxhash64("digest"), F.col("nb")).cast("int")).join(sets, "digest")
    spread = chunked.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.select("family", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"), "digest", "root", "shingles")
    more = materialise(spread.groupBy("family", "_i", "_j").applyInArrow(_meet(percent), "a binary, b binary"))

    # components are labelled anew only through the links that joined several
    tops = linked.toDF("_v", "_r")
    lifted = more.join(tops, F.col("a") == F.col("_v"), "left").select(F.coalesce("_r", "a").alias("a"), "b")
    lifted = materialise(lifted.join(tops, F.col("b") == F.col("_v"), "left").select("a", F.coalesce("_r", "b").alias("b")))
    higher = components(lifted).toDF("root", "top")
    final = member.join(higher, "root", "left").select("digest", F.coalesce("top", "root").alias("root"))
    with_rep = materialise(final.join(wanted.select("digest", "rep"), "digest"))
    smallest = with_rep.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = with_rep.join(smallest, "root").select("digest", "component_id")
    return _finish(sketch, classes, of_class, broadcast_keys)


def _finish(sketch: DataFrame, classes: DataFrame, of_class: DataFrame, broadcast_keys: int) -> DataFrame:
    """Give each row its class's component; classes of one row that link to nothing need no look-up."""
    named = classes.select("digest", "rep", "size").join(of_class, "digest", "left")
    facts = materialise(named.where("size > 1 OR component_id IS NOT NULL").select("digest", "size", F.coalesce("component_id", "rep").alias("component_id")))
    total, n_facts = sketch.count(), facts.count()
    slim = sketch.select("id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = attach(slim.where("digest IS NOT NULL"), facts, "digest", "size", total, n_facts, F.col("id"), broadcast_keys)
    empty = slim.where("digest IS NULL").select("id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    every = out.select("id", "text_key", "n_shingles", "component_id").unionByName(empty)
    found = F.coalesce("component_id", "id")
    return every.select(F.col("id").alias("doc_id"), "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"), "text_key")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key")


ORACLE = """
WITH RECURSIVE toks AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM toks),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
