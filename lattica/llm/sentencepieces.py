"""SentencePiece models rebuilt for the tokenizers library: encoding, decoding and a check of parity."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import pick, release, table

MARK = "▁"
#: SentencePiece.Type and TrainerSpec.ModelType of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads that encode a batch, bytes of text in a batch, and bytes that words and their identifiers may take in a worker.
THREADS, BATCH_BYTES, KEPT_BYTES = 2, 1 << 21, 1 << 25


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    mark_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message: varints as numbers, others as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire)
        if n is None:
            if wire != 2:
                raise ValueError(f"wire type {wire}")
            n = varint()
        yield tag >> 3, data[i : i + n]
        i += n


def parse_model(data: bytes) -> Model:
    """What encoding needs of a ModelProto: pieces (1), trainer (2: kind 3, byte fallback 35), normaliser (3)."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece: dict[int, int | bytes] = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_spaces, model.mark_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def build_tokenizer(model: Model):
    """The tokenizers-library equivalent: normaliser, space marker, scores or merges, byte fallback, decoder.

    A unigram model keeps its scores. A BPE model's scores rank its merges: every split of a piece into two
    pieces is a merge, better scores first and, among splits of one piece, the longer left side first.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [(-s, -k, p[:k], p[k:]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        merges.sort()
        core = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=[(a, b) for _, _, a, b in merges], unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)] * model.mark_spaces
    out.normalizer = normalizers.Sequence(steps)
    decode = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix
    out.decoder = decoders.Sequence(decode)
    defined = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if defined:
        out.add_tokens(defined)
    return out


class Codec:
    """Encodes and decodes batches with the rebuilt tokenizer, and tells where the sentencepiece library differs.

    Where no piece holds a space marker behind another character, and the normaliser changes nothing but spaces, merges
    never cross the start of a word. Texts with single spaces only are then made of their words; distinct words are
    encoded, compared and decoded once, and kept, in flat arrays of KEPT_BYTES at most, for the batches that follow. All
    other texts, and all texts of other models, go by the whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        m = self.model = parse_model(data)
        self.backend = build_tokenizer(m)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [p for p, _, _ in m.pieces]
        self.by_word = m.kind == BPE and m.dummy_prefix and m.mark_spaces and not m.squeeze_spaces and not m.charsmap and all(MARK not in p.lstrip(MARK) for p in pieces) and MARK in pieces and not any(kind == USER_DEFINED for _, _, kind in m.pieces)
        self._forget()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(identifiers of all texts, how many each has, whether decoding gives it again, whether the library agrees)."""
        mine = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.library.encode(texts, num_threads=THREADS)
        again = self.backend.decode_batch(mine, skip_special_tokens=False)
        counts = np.array([len(x) for x in mine], np.int64)
        ids = np.fromiter(chain.from_iterable(mine), np.int32, int(counts.sum()))
        return ids, counts, np.array([x == t for x, t in zip(again, texts)], bool), np.array([x == y for x, y in zip(mine, theirs)], bool)

    def _learnt(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As _whole, of self.words, which hold the given ones."""
        if self.words.nbytes + sum(x.nbytes for x in self.facts) > KEPT_BYTES:
            self._forget()
        new = words.filter(pc.invert(pc.is_in(words, value_set=self.words)))
        if len(new):
            self.facts = tuple(np.concatenate(pair) for pair in zip(self.facts, self._whole(new.to_pylist())))
            self.words = pa.concat_arrays([self.words, new])
        return self.facts

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.facts = tuple(np.zeros(0, kind) for kind in (np.int32, np.int64, bool, bool))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As _whole, of an array without nulls."""
        if not self.by_word:
            return self._whole(texts.to_pylist())
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        # the marker itself, in a text, can't be told from a space
        whole = np.asarray(pc.or_(pc.or_(odd, pc.match_substring(texts, MARK)), pc.equal(pc.utf8_length(texts), 0)))
        split = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        coded = split.flatten().dictionary_encode()
        word_ids, sizes, trips, same = self._learnt(coded.dictionary)
        word_at = np.cumsum(sizes) - sizes
        place = np.asarray(pc.index_in(coded.dictionary, value_set=self.words), np.int64)
        codes, bounds = place[np.asarray(coded.indices)], np.asarray(split.offsets) - split.offsets[0].as_py()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = word_ids[np.repeat(word_at[codes] - ends[:-1], n) + np.arange(ends[-1])]
        faults = [np.concatenate([[0], np.cumsum(~good[codes])]) for good in (trips, same)]
        if not whole.any():
            return ids, np.diff(ends[bounds]), np.diff(faults[0][bounds]) == 0, np.diff(faults[1][bounds]) == 0
        out = [np.zeros(len(whole), np.int64), np.zeros(len(whole), bool), np.zeros(len(whole), bool)]
        other_ids, *others = self._whole(texts.filter(pa.array(whole)).to_pylist())
        for mine, plain, other in zip(out, (np.diff(ends[bounds]), np.diff(faults[0][bounds]) == 0, np.diff(faults[1][bounds]) == 0), others):
            mine[~whole], mine[whole] = plain, other
        every = np.zeros(int(out[0].sum()), np.int32)
        from_whole = np.repeat(whole, out[0])
        every[~from_whole], every[from_whole] = ids, other_ids
        return every, *out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Identifiers of each text, and whether the library has the same."""
        ids, counts, _, same = self.batch(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]), same.tolist()

    def decode(self, ids: np.ndarray) -> str:
        return self.backend.decode(ids.tolist(), skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def _encoder(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = public_tokenizers.path(name)
        codec = _codecs.get(path) or _codecs.setdefault(path, Codec(path))
        for whole in batches:
            texts = whole.column(1).fill_null("")
            chars = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(texts), np.int64))])
            at = 0
            while at < whole.num_rows:
                end = min(whole.num_rows, max(at + 1, int(np.searchsorted(chars, chars[at] + BATCH_BYTES, "right")) - 1))
                ids, counts, trips, same = codec.batch(texts.slice(at, end - at))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, end - at), pa.array(counts), lists, pa.array(trips), pa.array(same)], ["doc_id", "n_tokens", "token_ids", "round_trip", "parity"])
                at = end
        release()

    return run


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per row: doc_id, n_tokens, token_ids, round_trip (decoding gives the text again), parity.

    token_ids are those of the rebuilt tokenizer, without begin or end; parity tells that the sentencepiece library
    has the same. A null text is empty and has no tokens; its round trip is true. Rows are on their own, so repeated
    rows and null ids each give a row; other columns are ignored; an empty table gives no rows. Whole texts are
    encoded, in batches of about BATCH_BYTES; what is kept between batches has KEPT_BYTES at most, so memory is bounded
    by these and the longest text.
    """
    rows = pick(docs, id=id_col, text=text_col)
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_encoder(model), f"doc_id {kind}, n_tokens long, token_ids array<int>, round_trip boolean, parity boolean")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
