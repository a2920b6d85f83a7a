"""Language-model scores by stupid backoff, against n-gram counts of all other documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pick, release, table
from .shingles import CHUNK_BYTES, mix, text_chunks, word_hashes

ALPHA = 0.4
ORDER = 3
#: Bytes of text in a block of documents, n-grams (of a block, all orders) in a part of the count table, and bytes of
#: text that a task gathers before it packs them by block.
BLOCK_BYTES, PART_GRAMS, GATHER_BYTES = 8_000_000, 1_500_000, 32_000_000
#: N-gram hashes have so many bits that the expected number of pairs that share one, in the whole corpus, is below
#: 2 ** -SAFE; LEAST_BITS at least.
SAFE, LEAST_BITS = 6, 64
_SALT = mix(np.arange(1, 64, dtype=np.uint64))
_MORE = mix(np.arange(101, 164, dtype=np.uint64)) | np.uint64(1)


def hash_bits(grams: int) -> int:
    """Bits for a corpus with at most so many n-grams: at n of them, n * n / 2 pairs share b bits with probability 2 ** -b each."""
    return max(LEAST_BITS, math.ceil(2 * math.log2(max(2, grams)) - 1 + SAFE))


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed: the high ones of small numbers take next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    if len(values) < 16:  # as few as these would only grow
        return b"\0" + planes
    return b"\1" + len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\0":
        n, planes = len(data) // 8, data[1:]
    else:
        n = int.from_bytes(data[1:9], "little")
        planes = zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=8 * n + 1)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).reshape(-1).view("<u8")


def _gathered() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of a block, one after another in one compressed value, and their ids."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
        values, ids = [], []
        for first, end in zip(starts, np.r_[starts[1:], len(order)]):
            part = rows.take(pa.array(order[first:end]))
            texts = part.column("text").combine_chunks()
            lengths = np.asarray(pc.binary_length(texts), np.int64)
            values.append(len(lengths).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(data.tobytes() for _, _, data, _ in text_chunks(texts))))
            ids.append(part.column("id").combine_chunks())
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        every = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.array(block[order][starts], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), every), pa.array(values, pa.binary())], ["block", "ids", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GATHER_BYTES:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)
        release()

    return run


def _texts(values: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of texts, as _gathered packed them."""
    for value in values:
        data = value.as_py()
        n = int.from_bytes(data[:8], "little")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data[8:]), np.uint8)
        ends = np.r_[0, np.cumsum(raw[: 8 * n].view(np.int64))]
        raw = raw[8 * n :]
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_BYTES, "right")) - 1)
            yield raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
            first = last


class _Grams:
    """All n-grams of a block's texts, order by order, by place: their hashes (heads, and tails of the bits beyond 64)."""

    def __init__(self, texts: pa.ChunkedArray, bits: int) -> None:
        heads: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        tails: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
        lengths: list[np.ndarray] = [np.zeros(0, np.int64)]
        for data, offsets in _texts(texts):
            words, at = word_hashes(data, offsets)
            n = np.diff(at)
            lengths.append(n)
            left = np.repeat(at[1:], n) - np.arange(len(words))  # words from here to the text's end
            head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
            for k in range(ORDER):
                end = max(0, len(words) - k)
                fits = left[:end] > k
                head = mix(head[:end] * np.uint64(0x9E3779B97F4A7C15) + words[k:] + _SALT[k])
                heads[k].append(head[fits])
                if bits > 64:
                    tail = mix(tail[:end] * np.uint64(0xD6E8FEB86659FD93) + words[k:] * _MORE[k])
                    tails[k].append(tail[fits] >> np.uint64(128 - bits))
        self.lengths = np.concatenate(lengths)
        none = [np.zeros(0, np.uint64)]
        self.sizes = [sum(map(len, h)) for h in heads]
        self.heads = np.concatenate(none + [x for h in heads for x in h])
        self.tails = np.concatenate(none + [x for t in tails for x in t]) if bits > 64 else None


def _distinct(heads: np.ndarray, tails: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Distinct hashes in order, and which of them each one is."""
    if tails is None:
        unique, which = np.unique(heads, return_inverse=True)
        return unique, None, which
    order = np.lexsort((tails, heads))
    heads, tails = heads[order], tails[order]
    new = np.r_[True, (heads[1:] != heads[:-1]) | (tails[1:] != tails[:-1])][: len(heads)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return heads[new], tails[new], which


def _explode(parts: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """A block's distinct n-grams with their counts, cut by the part of the count table that their hashes fall in."""

    def run(block: pa.Table) -> pa.Table:
        grams = _Grams(block.column("texts"), bits)
        heads, tails, which = _distinct(grams.heads, grams.tails)
        counts = np.bincount(which, minlength=len(heads))
        part = (heads >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)]))[: len(starts)]
        number = block.column("block")[0].as_py()
        return pa.table(
            {
                "part": pa.array(part[starts].astype(np.int32)),
                "block": pa.array([number] * len(starts), pa.int32()),
                "grams": pa.array([_pack(np.diff(heads[i:j], prepend=np.uint64(0))) for i, j in cuts], pa.binary()),
                "tails": pa.array([None if tails is None else _pack(tails[i:j]) for i, j in cuts], pa.binary()),
                "counts": pa.array([_pack(counts[i:j]) for i, j in cuts], pa.binary()),
            }
        )

    return run


def _count(part: pa.Table) -> pa.Table:
    """Counts in all blocks of one part's n-grams; each block gets what the others have of its own."""
    heads = [np.cumsum(_unpack(g.as_py()), dtype=np.uint64) for g in part.column("grams")]
    tails = [_unpack(t.as_py()) for t in part.column("tails") if t.is_valid]
    counts = np.concatenate([_unpack(c.as_py()) for c in part.column("counts")]).astype(np.int64)
    ends = np.cumsum([len(g) for g in heads])
    unique, _, which = _distinct(np.concatenate(heads), np.concatenate(tails) if tails else None)
    total = np.bincount(which, counts, len(unique)).astype(np.int64)  # exact up to 2 ** 53
    elsewhere = total[which] - counts
    return pa.table({"block": part.column("block"), "part": part.column("part"), "elsewhere": pa.array([_pack(x) for x in np.split(elsewhere, ends[:-1])], pa.binary())})


def _score(bits: int, all_words: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        grams = _Grams(docs.column("texts"), bits)
        lengths, sizes = grams.lengths, grams.sizes
        heads, _, which = _distinct(grams.heads, grams.tails)
        grams.heads = grams.tails = None
        blobs = sorted(zip(found.column("part").to_pylist(), found.column("elsewhere").to_pylist()))
        elsewhere = np.concatenate([_unpack(b) for _, b in blobs]) if blobs else np.zeros(0, np.uint64)
        total = np.bincount(which, minlength=len(heads)) + elsewhere.astype(np.int64)
        n_docs, words = len(lengths), int(lengths.sum())
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        # counts without the document's own, at the place of each n-gram's first word; -1 where none begins
        others: list[np.ndarray] = []
        for k, place in enumerate(np.split(which, np.cumsum(sizes)[:-1])):
            each = np.maximum(lengths - k, 0)
            _, own, repeats = np.unique(np.repeat(np.arange(n_docs), each) * max(1, len(heads)) + place, return_inverse=True, return_counts=True)
            at = np.full(words, -1, np.int64)
            first = np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
            at[np.repeat(starts, each) + first] = total[place] - repeats[own]
            others.append(at)
        rest = np.repeat(all_words - lengths, lengths).astype(np.float64)
        seen = others[0] > 0
        log = np.where(seen, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(rest, 1)), math.log(ALPHA) - np.log(rest + 1))
        order = seen.astype(np.int64)
        for k in range(1, ORDER):
            whole, context = np.full(words, -1, np.int64), np.full(words, -1, np.int64)
            if words > k:  # the n-gram that ends at a word begins k words before
                whole[k:], context[k:] = others[k][:-k], others[k - 1][:-k]
            fits = whole >= 0  # no n-gram reaches back into another text
            hit = whole > 0
            better = np.log(np.maximum(whole, 1)) - np.log(np.maximum(context, 1))
            log = np.where(hit, better, np.where(fits, log + math.log(ALPHA), log))
            order = np.where(hit, k + 1, order)
        owner = np.repeat(np.arange(n_docs), lengths)
        summed = np.bincount(owner, log, n_docs)
        by = [np.bincount(owner[order == k], minlength=n_docs).astype(np.int64) for k in range(ORDER + 1)]
        ids = pa.concat_arrays([pa.array([], kind), *(x.values for x in docs.column("ids") if x.values is not None)])
        return pa.table({"doc_id": ids, "n_words": pa.array(lengths.astype(np.int64)), "log_score": pa.array(np.round(summed, 6) + 0.0)} | {f"n_order{k}": pa.array(by[k]) for k in range(ORDER + 1)})

    return run


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, log_score (natural logarithm, summed over words), n_order0 to n_order3.

    Words are runs of other characters than space and U+0009 to U+000D, A-Z in lower case. A word scores
    c(n-gram) / c(its context) at the highest order up to 3, within its text, at which the rest of the corpus has
    the n-gram; each order missed costs a factor of ALPHA. c counts all rows but the one that is scored, so a score
    says how well the others predict it. A word that none of them has scores ALPHA / (their words + 1). n_orderK
    counts the words scored at order K (0: not seen). Null and wordless texts score 0 with no words; repeated rows
    count as rows, and each is in the others' counts; null ids are scored like any; other columns are ignored; an
    empty table gives no rows.

    N-grams are told apart by hashes of 64 bits or more (hash_bits), words by 64 bits.

    Method: documents are hashed to blocks, their texts packed. A block's n-grams are exploded and counted; they travel
    as sorted hashes, packed by part of the hash range, to the count table, which is partitioned by hash. A part joins
    what all blocks have of its range, and gives back to each block how often the others have its n-grams. A block then
    sums its documents' scores. A very common n-gram is one entry a block, however often it occurs.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    stats = rows.agg(F.sum(F.octet_length("text").cast("long")), F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long"))).first()
    n_bytes, n_words = (int(x or 0) for x in stats)
    grams = max(2, ORDER * n_words)
    bits = hash_bits(grams)
    blocks, parts = max(1, math.ceil(n_bytes / BLOCK_BYTES)), max(1, math.ceil(grams / PART_GRAMS))
    kind = dict(rows.dtypes)["id"]
    arrow_kind = to_arrow_type(rows.schema["id"].dataType)
    placed = rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"))
    blocked = placed.mapInArrow(_gathered(), f"block int, ids array<{kind}>, texts binary").repartition(blocks, "block")
    exploded = blocked.groupBy("block").applyInArrow(_explode(parts, bits), "part int, block int, grams binary, tails binary, counts binary")
    counted = exploded.groupBy("part").applyInArrow(_count, "block int, part int, elsewhere binary")
    schema = f"doc_id {kind}, n_words long, log_score double, " + ", ".join(f"n_order{k} long" for k in range(ORDER + 1))
    return blocked.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_score(bits, n_words, arrow_kind), schema)


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT r, i, w AS g1, CASE WHEN i > 1 THEN lag(w) OVER o || ' ' || w END AS g2, CASE WHEN i > 2 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w END AS g3,
    CASE WHEN i > 1 THEN lag(w) OVER o END AS x1, CASE WHEN i > 2 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o END AS x2 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
every AS (SELECT r, g1 AS g FROM g UNION ALL SELECT r, g2 FROM g WHERE g2 IS NOT NULL UNION ALL SELECT r, g3 FROM g WHERE g3 IS NOT NULL),
own AS (SELECT r, g, count(*) AS n FROM every GROUP BY r, g),
c AS (SELECT r, g, sum(n) OVER (PARTITION BY g) - n AS c FROM own),
s AS (SELECT g.r, c1.c AS c1, c2.c AS c2, c3.c AS c3, d1.c AS d1, d2.c AS d2, i,
    (SELECT sum(len(w)) FROM t) - len(t.w) AS rest
  FROM g JOIN t ON t.r = g.r JOIN c c1 ON c1.r = g.r AND c1.g = g1 LEFT JOIN c c2 ON c2.r = g.r AND c2.g = g2 LEFT JOIN c c3 ON c3.r = g.r AND c3.g = g3
  LEFT JOIN c d1 ON d1.r = g.r AND d1.g = x1 LEFT JOIN c d2 ON d2.r = g.r AND d2.g = x2),
scored AS (SELECT r, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS k,
    CASE WHEN c3 > 0 THEN ln(c3) - ln(d2) WHEN c2 > 0 THEN ln(c2) - ln(d1) + CASE WHEN i > 2 THEN ln(0.4e0) ELSE 0 END
      WHEN c1 > 0 THEN ln(c1) - ln(rest) + least(i - 1, 2) * ln(0.4e0) ELSE ln(0.4e0) - ln(rest + 1) + least(i - 1, 2) * ln(0.4e0) END AS l FROM s)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(sum(l), 0e0), 6) + 0e0 AS log_score,
  count(*) FILTER (WHERE k = 0) AS n_order0, count(*) FILTER (WHERE k = 1) AS n_order1, count(*) FILTER (WHERE k = 2) AS n_order2, count(*) FILTER (WHERE k = 3) AS n_order3
FROM t LEFT JOIN scored USING (r) GROUP BY r, doc_id, w
"""
