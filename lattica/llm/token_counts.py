"""Token counts by byte-pair merging with a heap and a linked list; identifiers are never made."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: Words whose counts a Python worker keeps; beyond, it starts anew. Longer words than KEPT_CHARS aren't kept: 250 MB at most.
CACHED_WORDS, KEPT_CHARS = 1_000_000, 64
#: What byte-level BPE splits text by before it merges: a fixed pattern of the public vocabulary.
PATTERN = public_tokenizers.PATTERN


def _byte_symbols() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairMerger(dict):
    """Counts of words by text; a missing one is merged.

    A word's bytes are a doubly linked list, its mergeable neighbours a heap by rank and place. The lowest is
    popped and, unless one of its sides has been merged since, joined; each merge takes one symbol away.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kind = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options")
        vocabulary = model["vocab"]
        self.symbols = [vocabulary[s] for s in _byte_symbols()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.words = regex.compile(PATTERN)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(word) <= KEPT_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: bytes) -> int:
        symbols = [self.symbols[b] for b in word]
        n = len(symbols)
        get = self.merges.get
        heap = [(found[0], i, a, b, found[1]) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := get((a, b)))]
        if not heap:
            return n
        heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            _, i, a, b, joined = heappop(heap)
            j = following[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = joined, -1
            k = following[i] = following[j]
            left -= 1
            if k < n:
                before[k] = i
                if found := get((joined, symbols[k])):
                    heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := get((symbols[h], joined))):
                heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return left

    def count(self, text: str) -> int:
        if self.at_special is None or not self.at_special.search(text):
            return sum(map(self.__getitem__, self.words.findall(text)))
        parts = self.at_special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.words.findall(p))) for p in parts)


_mergers: dict[str, PairMerger] = {}


def _counter(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(name)
        merger = _mergers.get(path) or _mergers.setdefault(path, PairMerger(path))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            counts = [merger.count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is empty: 0 bytes, 0 tokens. Strings of the vocabulary's special tokens count as one token each, as
    the tokenizers library does by default; no tokens are added and nothing is cut. Rows are on their own, so
    repeated rows and null ids each give a row; other columns are ignored; an empty table gives no rows. A word of
    n bytes takes n log n steps, so one endless word is no worse than a long text.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_counter(tokenizer, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
