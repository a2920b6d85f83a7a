"""Toxicity by compression distance, with thresholds calibrated on labelled documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression
from .common import materialise, pick, release, table

#: Documents and characters that are sampled from each class, all on the driver, for the dictionaries. Thresholds are
#: calibrated on all labelled documents: sampled ones by margins of each of FOLDS parts under dictionaries of the others.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 12_000_000
FOLDS = 6
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Steps of the evidence scale, and where it ends: more than TOP standard deviations count as TOP.
STEPS, TOP = 8, 16


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scorer:
    """Dictionaries of both classes, and the share of toxic documents by the margins of their windows.

    Evidence is how far the sum of a document's positive margins, and how far their number, exceed what ordinary text of
    that length has by chance (saved bytes and hits a window), in standard deviations, added. curve has the share of toxic
    documents by evidence.
    """

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]) -> None:
        self.ordinary, self.toxic = ordinary, toxic
        self.curve, self.saved, self.hits = [0.0], 0.0, 0.0
        self._lengths: compression.Lengths | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lengths": None}  # compressors are made anew in each worker

    def positive(self, text: bytes) -> tuple[int, int, int]:
        """Of a normalised text: the sum of positive margins, how many are positive, and how many windows there are."""
        if self._lengths is None:
            self._lengths = compression.Lengths(self.ordinary, self.toxic)
        margins = self._lengths.margins(text)
        above = [m for m in margins if m > 0]
        return sum(above), len(above), len(margins)

    def place(self, saved: int, hits: int, windows: int) -> int:
        """Evidence in steps of 1 / STEPS. A hit saves some three bytes."""
        by_sum, by_hits = self.saved * windows, self.hits * windows
        return math.floor(STEPS * ((saved - by_sum) / math.sqrt(3 * by_sum + 9) + (hits - by_hits) / math.sqrt(by_hits + 0.5)))

    def score(self, text: str | None) -> float:
        found = self.positive(compression.normal(text or ""))
        return min(1.0, self.curve[max(0, min(self.place(*found), len(self.curve) - 1))] + 1e-3 * (1 - 1 / (1 + found[0])))


def calibrated(places: dict[tuple[int, bool], int], weights: dict[bool, float], bins: int = TOP * STEPS) -> list[float]:
    """Share of toxic documents by place on a scale, never falling: neighbours that would fall are pooled."""
    hits, all_, seen = [0.0] * bins, [0.0] * bins, [0] * bins
    for (place, toxic), n in places.items():
        k = max(0, min(place, bins - 1))
        hits[k] += weights[toxic] * toxic * n
        all_[k] += weights[toxic] * n
        seen[k] += n
    pools: list[list[float]] = []
    for h, n, docs in zip(hits, all_, seen):
        pools.append([h, n, docs, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    base = sum(hits) / sum(all_) if sum(all_) else 0.0
    out: list[float] = []
    for h, n, docs, width in pools:
        share, spread = (h + base) / (n + 1), 1 / math.sqrt(docs + 1)
        # what the share is at least, with a confidence of 0.84: a few documents prove little
        out += [max(0.0, (share + spread**2 / 2 - spread * math.sqrt(share * (1 - share) + spread**2 / 4)) / (1 + spread**2))] * int(width)
    return list(accumulate(out, max))


def _evidence(scorer: Scorer, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                text = compression.normal(t.as_py() or "")
                found.append((xxhash.xxh3_64_intdigest(text) - 2**63, *scorer.positive(text)))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            kept = batch.columns if carry else batch.columns[:1]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*batch.schema.names[: len(kept)], "mark", "saved", "hits", "windows"])
            release()

    return run


def _place(scorer: Scorer) -> Column:
    """Scorer.place as an expression, the same steps in the same order."""
    by_sum, by_hits = (F.lit(float(rate)) * F.col("windows") for rate in (scorer.saved, scorer.hits))
    of_sum, of_hits = (F.col("saved") - by_sum) / F.sqrt(F.lit(3.0) * by_sum + F.lit(9.0)), (F.col("hits") - by_hits) / F.sqrt(by_hits + F.lit(0.5))
    return F.least(F.greatest(F.floor(F.lit(float(STEPS)) * (of_sum + of_hits)), F.lit(0)), F.lit(TOP * STEPS - 1))


def _trained(rows: DataFrame, marks: DataFrame, carry: bool = False) -> tuple[Scorer, DataFrame]:
    """The scorer, and (id, mark, saved, hits, windows) of all rows (id, text, ...) under it; marks: id, toxic.

    With carry the evidence has all columns of rows, so texts that are scored needn't be met again.
    """
    known = rows.where("id IS NOT NULL AND text IS NOT NULL")
    counts = {bool(r["toxic"]): r["count"] for r in marks.groupBy("toxic").count().collect()}
    sized = known.select("id", F.length("text").alias("chars")).join(marks, "id")
    chosen: list[tuple[int, bool]] = []
    for toxic in (True, False):
        some = sized.where(F.col("toxic") == int(toxic)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).collect()
        left = SAMPLE_CHARS
        for r in {r["id"]: r for r in some}.values():
            if r["chars"] <= left:
                chosen.append((r["id"], toxic))
                left -= r["chars"]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, "id long, toxic boolean"))  # 2 * SAMPLE_DOCS at most
    texts = known.join(wanted, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id").collect()
    # near copies count once, also so that they don't stand on both sides of a fold
    distinct = {toxic: compression.diverse(compression.normal(r["text"]) for r in texts if r["toxic"] == toxic) for toxic in (True, False)}
    *parts, scorer = [Scorer(*pair) for pair in compression.train(distinct[True], distinct[False], FOLDS)]
    kept = ", ".join(f"`{name}` {kind}" for name, kind in (rows.dtypes if carry else rows.dtypes[:1]))
    evidence = materialise(rows.mapInArrow(_evidence(scorer, carry), f"{kept}, mark long, saved long, hits long, windows long"))
    if not scorer.toxic:
        scorer.curve = [counts.get(True, 0) / max(1, sum(counts.values()))]
        return scorer, evidence
    found = [(part.positive(t), toxic) for toxic, own in distinct.items() for f, part in enumerate(parts) for t in own[f::FOLDS]]
    # what isn't in the sample is counted on the cluster, equal texts once; the dictionaries haven't seen it
    numbers = [F.first(c).alias(c) for c in ("saved", "hits", "windows")]
    others = evidence.groupBy("id", "mark").agg(*numbers).join(marks, "id").join(wanted, "id", "left_anti").groupBy("mark", "toxic").agg(*numbers)
    others = materialise(others)
    all_ = others.groupBy("toxic").agg(F.count(F.lit(1)), *[F.sum(c) for c in ("saved", "hits", "windows")]).collect()
    by_chance = next((list(r)[2:] for r in all_ if not r["toxic"]), [0, 0, 0])
    saved, hits, windows = (sum(e[k] for e, toxic in found if not toxic) + more for k, more in enumerate(by_chance))
    scorer.saved, scorer.hits = saved / max(1, windows), hits / max(1, windows)
    places = Counter((scorer.place(*e), toxic) for e, toxic in found)
    for r in others.groupBy(_place(scorer).alias("place"), "toxic").count().collect():  # TOP * STEPS places
        places[r["place"], bool(r["toxic"])] += r["count"]
    seen = Counter({toxic: len(own) for toxic, own in distinct.items()}) + Counter({bool(r["toxic"]): r[1] for r in all_})
    scorer.curve = calibrated(places, {toxic: counts.get(toxic, 0) / max(1, seen[toxic]) for toxic in (True, False)})
    return scorer, evidence


def _marks(labels: DataFrame, id_col: str, label_col: str, keep: Column | None) -> DataFrame:
    marks = pick(labels, id=id_col, toxic=label_col).where("toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    return marks if keep is None else marks.where(keep)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: Column | None = None) -> Scorer:
    """Dictionaries from a seeded, bounded sample of labelled documents (SAMPLE_DOCS and SAMPLE_CHARS of either class),
    thresholds from all of them.

    keep is a condition on "id". Labels other than 0 and 1 are left out; a document that has both counts as toxic; of
    rows that repeat an id the smallest text is in the sample, and outside it each counts.
    With no toxic or no ordinary documents every text gets the same score, their share.
    """
    rows = pick(docs, id=id_col, text=text_col)
    return _trained(rows if keep is None else rows.where(keep), _marks(labels, id_col, label_col, keep))[0]


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 where score >= THRESHOLD).

    Labels of held-out documents (crc32 of the id as text leaves 1 by 3) are never read. A null text is empty; empty
    texts score what no margin means. The whole text is scored, window by window, from its bytes alone. Null ids are
    not held out; repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """
    return _scored(pick(docs, id=id_col, text=text_col), labels, id_col, label_col).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, all their columns, whose score is below THRESHOLD; scores are those of score_toxicity.

    Each text is scored once: rows are written with what is found in them, and filtered when thresholds are known.
    """
    names = list(docs.columns)
    others = [i for i, name in enumerate(names) if i not in (names.index(id_col), names.index(text_col))]
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = plain.select(F.col(f"_c{names.index(id_col)}").alias("id"), F.col(f"_c{names.index(text_col)}").alias("text"), *[f"_c{i}" for i in others])
    clean = _scored(rows, labels, id_col, label_col, carry=True).where("predicted = 0")
    return clean.select(*[F.col("id" if i == names.index(id_col) else "text" if i == names.index(text_col) else f"_c{i}").alias(name) for i, name in enumerate(names)])


def _scored(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, carry: bool = False) -> DataFrame:
    """id (and all of rows, with carry), held_out, score, predicted."""
    scorer, evidence = _trained(rows, _marks(labels, id_col, label_col, ~is_held_out(F.col("id"))), carry)
    share = F.get(F.lit(scorer.curve), _place(scorer)) if scorer.toxic else F.lit(scorer.curve[0])
    score = F.least(F.lit(1.0), share + F.lit(1e-3) * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("saved"))))
    scored = evidence.select(*(rows.columns if carry else ["id"]), is_held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
