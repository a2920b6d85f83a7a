"""Compression distance: one zstandard dictionary a class, and the lengths of a text's windows under both."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator, Sequence

import numpy as np
import xxhash
import zstandard

#: Window and step in bytes. Below 64 bytes zstandard writes literals as they are, so lengths differ by matches only;
#: windows overlap by more than a dictionary segment is long.
WINDOW, STEP = 60, 44
#: Both dictionaries, and every window, end with these bytes: a sure match, without which short blocks are stored raw.
ANCHOR = bytes(range(1, 9)) + bytes(range(14, 32))
#: Bytes of the n-grams that segments cover, the longest a segment grows, and the share of a segment's texts that must
#: hold an n-gram for the segment to grow over it.
GRAM, LONGEST, AGREE = 5, 16, 0.6
#: The toxic dictionary holds what this share of toxic texts has, the ordinary one what DEPTH times fewer ordinary texts have.
#: With few toxic texts it must be more: SURE standard deviations above the share below which the ordinary one has nothing.
SUPPORT, DEPTH, SURE = 0.05, 2.0, 4.0
#: zstandard indexes dictionaries by every third byte first; equal padding keeps the shared part's entries the same.
ALIGN = 12
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case for A-Z, one space for each run of other ASCII characters than letters and digits."""
    return b" " + b" ".join(text.encode("utf-8", "replace").lower().translate(_PLAIN).split()) + b" "


def windows(text: bytes) -> Iterator[bytes]:
    for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP):
        yield text[i : i + WINDOW]


def _grams(text: bytes) -> np.ndarray:
    """Distinct n-grams as numbers; those with a space inside are left out."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    code = np.zeros(len(data) - GRAM + 1, np.uint64)
    inner = np.zeros(len(code), bool)
    for k in range(GRAM):
        part = data[k : k + len(code)]
        code = (code << np.uint64(8)) | part.astype(np.uint64)
        if 0 < k < GRAM - 1:
            inner |= part == 32
    return np.unique(code[~inner])


def diverse(texts: Iterable[bytes]) -> list[bytes]:
    """Texts of which no earlier one shares two of its smallest shingle hashes: near copies would count many times."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    mults = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
    for text in texts:
        words = text.split()
        shingles = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        least = [int(((shingles ^ (shingles >> np.uint64(29))) * m >> np.uint64(7)).min()) for m in mults]
        keys = {(k, least[2 * k], least[2 * k + 1]) for k in range(3)}
        if not keys & seen:
            out.append(text)
        seen |= keys
    return out


def held_by(texts: Sequence[bytes], folds: int) -> list[dict[bytes, int]]:
    """How many texts hold each n-gram: for every fold (text i is in fold i % folds) among the texts outside it; last, among all."""
    grams = [_grams(t) for t in texts]
    codes, counts = np.unique(np.concatenate([*grams, np.zeros(0, np.uint64)]), return_counts=True)
    codes, counts = codes[counts >= 3], counts[counts >= 3]
    inside = np.zeros((folds + 1, len(codes)), np.int64)
    for i, own in enumerate(grams):
        place = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
        inside[i % folds, place[codes[place] == own] if len(codes) else []] += 1
    names = [int(c).to_bytes(GRAM, "big") for c in codes.tolist()]
    return [dict(zip(names, (counts - out).tolist())) for out in inside]


def train_segments(held_by: dict[bytes, int], least: float, covered: Collection[bytes] = ()) -> list[bytes]:
    """Segments that cover the n-grams which at least so many texts of a class hold, the most frequent first.

    An n-gram that no segment covers yet, and that isn't in covered, starts the next segment; this grows to the right,
    then to the left, over the n-gram most texts hold, while AGREE times as many hold it as hold the first one.
    """
    held = {gram: n for gram, n in held_by.items() if n >= least}
    after: dict[bytes, list[tuple[int, bytes]]] = defaultdict(list)
    before: dict[bytes, list[tuple[int, bytes]]] = defaultdict(list)
    for gram, n in held.items():
        after[gram[:-1]].append((n, gram[-1:]))
        before[gram[1:]].append((n, gram[:1]))
    most = [{key: max(near) for key, near in table.items()} for table in (after, before)]
    known = set(covered)
    segments = []
    for gram in sorted(held, key=lambda g: (-held[g], g)):
        if gram in known:
            continue
        segment = gram
        for right in (True, False):
            while len(segment) < LONGEST and (segment[-1:] if right else segment[:1]) != b" ":
                n, byte = most[0].get(segment[1 - GRAM :], (0, b"")) if right else most[1].get(segment[: GRAM - 1], (0, b""))
                if not byte or n < AGREE * held[gram]:
                    break
                segment = segment + byte if right else byte + segment
        segments.append(segment)
        known |= grams_of(segment)
    return segments


def grams_of(segment: bytes) -> set[bytes]:
    return {segment[i : i + GRAM] for i in range(len(segment) - GRAM + 1)}


def train(toxic: Sequence[bytes], ordinary: Sequence[bytes], folds: int) -> list[tuple[list[bytes], list[bytes]]]:
    """Segments of the ordinary dictionary, from ordinary texts alone, and of the toxic one, from toxic texts alone.

    One pair for each fold, from the texts outside it, and last one from all. Toxic texts are ordinary prose for the most
    part. So the toxic dictionary takes over the ordinary one's content, and only what this doesn't cover is trained: the
    same window then differs in length by what its class adds.
    """
    out = []
    sizes = [[len(texts) - len(texts[f::folds]) for f in range(folds)] + [len(texts)] for texts in (ordinary, toxic)]
    for n_ordinary, n_toxic, of_ordinary, of_toxic in zip(*sizes, held_by(ordinary, folds), held_by(toxic, folds)):
        plain = train_segments(of_ordinary, max(3, SUPPORT / DEPTH * n_ordinary))
        by_chance = SUPPORT / DEPTH * n_toxic
        least = max(4, SUPPORT * n_toxic, by_chance + SURE * by_chance**0.5)
        out.append((plain, train_segments(of_toxic, least, set().union(*map(grams_of, plain)))))
    return out


def dictionary(segments: list[bytes]) -> bytes:
    """Segments, the most telling last, each after a byte that normalised texts don't have."""
    content = b"".join(bytes([127]) + s for s in reversed(segments))
    return bytes([127]) * (-len(content) % ALIGN) + content


class Lengths:
    """Lengths of windows compressed with either class's dictionary."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]) -> None:
        shared = dictionary(ordinary) + bytes([127]) + ANCHOR
        self.ordinary, self.toxic = compressor(shared), compressor(dictionary(toxic) + shared)

    def margins(self, text: bytes) -> list[int]:
        """For each window of a whole normalised text, by how many bytes the toxic dictionary makes it shorter."""
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        return [len(ordinary(w)) - len(toxic(w)) for w in (window + ANCHOR for window in windows(text))]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=GRAM, target_length=0, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)
