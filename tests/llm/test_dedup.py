import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import exact_dedup, minhash, shingles
from lattica.llm.graph import components

from . import docs


def expected_exact(some):
    groups = defaultdict(list)
    for i, text, *_ in some:
        groups[text or ""].append(i)
    out = []
    for i, text, *_ in some:
        own = groups[text or ""]
        ids = [x for x in own if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(own), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"key_bits": 3}, {"broadcast_keys": 0}, {"key_bits": 2, "broadcast_keys": 0, "bucket_capacity": 1}, {"bucket_capacity": 2}])
def test_exact_dedup_is_brute_force(spark, options):
    got = exact_dedup.exact_dedup(docs.frame(spark), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_exact(docs.rows())


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs.frame(spark, [])).collect() == []


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(k << 59,) for k in range(8)] + [(-1 - k,) for k in range(8)], "key long")
    depth, buckets = exact_dedup.build_directory(keys, 2)
    assert depth > 1
    assert buckets[0][0] == 0 and buckets[-1][1] == 2**depth - 1
    assert all(a[1] + 1 == b[0] for a, b in zip(buckets, buckets[1:]))
    assert len({d for _, _, d in buckets}) > 1


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def expected_near(some, width, percent):
    sets = [shingle_set(t, width) for _, t, *_ in some]
    parent = list(range(len(some)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(some)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, *_) in enumerate(some):
        ids = [some[j][0] for j in range(len(some)) if find(j) == find(i) and some[j][0] is not None]
        low = min(ids) if ids else None
        out.append((doc, len(sets[i]), low, doc == low))
    return sorted(out, key=str)


def near_rows():
    """Chains and rings of near copies around centres that link to some of them only."""
    rng = np.random.default_rng(5)
    some = docs.rows()
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for c in range(25):
            words = list(base)
            for _ in range(int(rng.integers(0, 5))):
                words[int(rng.integers(0, 60))] = f"e{int(rng.integers(0, 9))}"
            some.append((1000 + 100 * g + c, " ".join(words), "en", "s0", 1))
    return some


@pytest.mark.parametrize(("width", "percent", "options"), [(3, 85, {}), (5, 80, {}), (3, 85, {"broadcast_keys": 0})])
def test_near_dedup_is_brute_force(spark, width, percent, options):
    some = near_rows()
    got = minhash.near_dedup(docs.frame(spark, some), width=width, percent=percent, **options).drop("text_key")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_near(some, width, percent)


def test_near_dedup_blocks_cut_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 4)
    some = near_rows()
    got = minhash.near_dedup(docs.frame(spark, some), width=3, percent=85).drop("text_key")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_near(some, 3, 85)


def test_near_dedup_of_nothing(spark):
    assert minhash.near_dedup(docs.frame(spark, [])).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:360], rng.integers(0, 2**64, 40, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = minhash.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - true) < 0.15
    one = minhash.signatures([a[:1], a[:1], np.zeros(0, np.uint64)])
    assert (one[0] == one[1]).all() and (one[0] == a[0]).all()


def test_shingles_equal_python_sets():
    texts = ["a b c d", "A  B\tc d", None, "", "x y", "a b c d a b c", "é ü é ü é"]
    sets = list(shingles.shingle_sets(pa.array(texts), 3))
    assert [len(s) for s in sets] == [len(shingle_set(t, 3)) for t in texts]
    assert (sets[0] == sets[1]).all()


def test_components(spark):
    chain = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(40)] + [(b"x", b"y"), (b"y", b"x"), (b"z", b"z")]
    roots = {bytes(r["v"]): bytes(r["root"]) for r in components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert len({roots[f"{i:03}".encode()] for i in range(41)}) == 1
    assert roots[b"x"] == roots[b"y"] != roots[b"000"]
