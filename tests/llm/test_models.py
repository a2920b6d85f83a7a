import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import ann, compression, mixing, queries, toxicity
from lattica.llm.mixing import min_cost_flow, water_fill

from . import docs
from .test_dedup import expected_near


def brute_fill(sizes, weights, copies):
    """The level at which the shares add up, by bisection."""
    total, lo, hi = sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(copies * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(copies * s, hi * w) for s, w in zip(sizes, weights)]


def test_water_fill():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = [rnd.randint(0, 1000) for _ in range(rnd.randint(1, 9))]
        weights = [1.0 + i % 3 for i in range(len(sizes))]
        assert water_fill(sizes, weights, 3) == pytest.approx(brute_fill(sizes, weights, 3), abs=1e-5)
    assert water_fill([], [], 3) == []


def test_flow_meets_quotas_at_least_cost():
    # the shared pattern serves both sources: repeating it evenly is cheaper than repeating either own one more often
    assert min_cost_flow([10, 10, 10], [[0], [1], [0, 1]], [15, 15], 3) == [10, 10, 10]
    assert min_cost_flow([10], [[0]], [25], 3) == [25]
    assert min_cost_flow([10], [[0]], [45], 3) == [30]
    assert sum(min_cost_flow([10, 5], [[0], [0, 1]], [10, 10], 3)) == 20
    assert min_cost_flow([0, 3], [[0], [1]], [2, 2], 3) == [0, 2]


def best_flow(capacities, members, quotas, copies):
    """The largest total and, at that, the least cost, over all ways to share words."""
    import itertools

    ways = [[w for w in itertools.product(range(copies * c + 1), repeat=len(own)) if sum(w) <= copies * c] for c, own in zip(capacities, members)]
    best = (1, 0)
    for chosen in itertools.product(*ways):
        into = [0] * len(quotas)
        for own, way in zip(members, chosen):
            for q, w in zip(own, way):
                into[q] += w
        if all(i <= q for i, q in zip(into, quotas)):
            cost = sum((k // c) ** 2 for c, way in zip(capacities, chosen) if c for k in range(sum(way)))
            best = min(best, (-sum(into), cost))
    return best


def test_flow_is_as_good_as_any():
    rnd = random.Random(8)
    for _ in range(60):
        n_q = rnd.randint(1, 3)
        members = [sorted(rnd.sample(range(n_q), rnd.randint(1, n_q))) for _ in range(rnd.randint(1, 3))]
        capacities, quotas = [rnd.randint(0, 2) for _ in members], [rnd.randint(0, 5) for _ in range(n_q)]
        taken = min_cost_flow(capacities, members, quotas, 2)
        cost = sum((k // c) ** 2 for c, t in zip(capacities, taken) if c for k in range(t))
        assert (-sum(taken), cost) == best_flow(capacities, members, quotas, 2)


def check_mix(rows, copies=3):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= copies * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = by.setdefault((r.source_size, r.target), [0, 0, []])
        s[0] += r.size
        s[1] += r.taken
        s[2].append(r.size)
    return by


def test_mixing(spark):
    got = mixing.mix_sources(docs.frame(spark)).collect()
    assert len(got) == len(docs.rows())
    assert sum(r.size for r in got) == sum(len((t or "").encode().split()) for _, t, *_ in docs.rows())
    sources = sorted({r[3] for r in docs.rows() if r[3] is not None}) + [None]
    sizes = [sum(len((t or "").encode().split()) for _, t, _, s, _ in docs.rows() if s == source) for source in sources]
    targets = dict(zip(sources, brute_fill(sizes, [1.0 + i % 3 for i in range(len(sources))], 3)))
    for (size, target), (own, taken, each) in check_mix(got).items():
        assert size == own
        assert any(target == pytest.approx(t, abs=1e-5) for t in targets.values())
        assert abs(taken - target) <= max(each) / 2 + 1
    again = mixing.mix_sources(docs.frame(spark).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(docs.frame(spark, [])).collect() == []


def test_mixing_cuts_large_patterns_by_hash(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BOUNDARY", 20)
    rnd = random.Random(4)
    some = [(i, " ".join(["w"] * rnd.randint(1, 30)), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(3000)]
    for (_, target), (_, taken, _) in check_mix(mixing.mix_sources(docs.frame(spark, some)).collect()).items():
        assert abs(taken - target) <= 15


def test_mixing_overlapping_sources(spark):
    rows = [(1, "a " * 10, ["x", "y"]), (2, "b " * 10, ["x"]), (3, "c " * 10, ["y", None]), (4, "d " * 10, []), (5, "e " * 10, None)]
    got = {r.doc_id: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()}
    assert got[4].source_size == got[5].source_size == 30
    assert all(r.size == 10 and r.taken <= 30 for r in got.values())
    # x and y have 20 words each, no source 30; weights 1, 2, 3 give 70 / 6 each, so 11.7, 23.3 and 35; the five rows' 50 words are 5 / 7 of these
    assert [got[k].target for k in (1, 2, 4)] == pytest.approx([70 / 6, 70 / 6, 35])
    assert sum(r.taken for r in got.values()) == pytest.approx(50, abs=10) and got[4].taken + got[5].taken >= 20


@pytest.mark.parametrize("boundary", [4096, 20])
def test_mixing_takes_repeated_ids_one_by_one(spark, monkeypatch, boundary):
    monkeypatch.setattr(mixing, "BOUNDARY", boundary)
    monkeypatch.setattr(mixing, "PIECE", 70)
    rows = [(None, "w " * 10, "en", "a", 1)] * 1000 + [(i, "v " * 10, "en", "b", 1) for i in range(1000)] + [(5, f"u{i} " * 10, "en", "c", 1) for i in range(1000)]
    by = check_mix(mixing.mix_sources(docs.frame(spark, rows)).collect())
    assert sorted((round(target), taken) for (_, target), (_, taken, _) in by.items()) == [(5000, 5000), (10000, 10000), (15000, 15000)]


def test_mixing_carries_rows(spark):
    rows = docs.rows() + [(7, "seven seven", "en", "s1", 1), (7, "another text of seven", "en", "s1", 2), (7, "another text of seven", "fr", "s1", 3)]
    frame = docs.frame(spark, rows)
    taken = mixing.mix_sources(frame).collect()
    got = mixing.take(frame)
    assert got.columns == frame.columns
    count = lambda values: sorted(map(str, values))
    size = lambda t: len((t or "").encode().split())
    assert count((r[0], size(r[1])) for r in got.collect()) == count((r.doc_id, r.size) for r in taken for _ in range(r.copies_taken))
    assert {str(r) for r in got.collect()} <= {str(r) for r in frame.collect()}


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    syllables = "an the re tion er on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    out, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 300))]
        toxic = i % 7 == 0
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words.insert(rnd.randint(0, len(words)), rnd.choice(["grobble", "vexnut", "Snarkwit", "drabzog"]))
        out.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic), "clash"))
    return out, labels


LABELS = "doc_id long, quality int, toxic int, TOXIC string"


def test_toxicity_on_held_out_documents(spark):
    some, labels = toxic_rows(1500, 3)
    odd = [(5000, None, "en", "s", 1), (5001, "", "en", "s", 1), (None, "plain", None, None, None), (5002, "x" * 100_000, "en", "s", 1)]
    extra = [(None, 1, 1, "c"), (9999, 1, None, "c"), (7, None, 1, "c"), (3, 1, 5, "c")]
    got = toxicity.score_toxicity(docs.frame(spark, some + odd), spark.createDataFrame(labels + extra, LABELS)).collect()
    assert len(got) == len(some) + len(odd)
    truth = {i: t for i, _, t, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(t and p for t, p in held) >= 0.9 * sum(t for t, _ in held)
    assert sum(p and not t for t, p in held) <= 0.02 * len(held)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id >= 5000)


def plainly_scored(scorer, text):
    """Scores anew: every window compressed by a compressor of its own, everything else written out."""
    import math

    import zstandard

    anchor = bytes([1, 2, 3, 4, 5, 6, 7, 8]) + bytes(range(14, 32))

    def content(segments):
        joined = b"".join(b"\x7f" + x for x in segments[::-1])
        while len(joined) % 12:
            joined = b"\x7f" + joined
        return joined

    plain = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").translate({i: i + 32 for i in range(65, 91)}))
    data = (" " + " ".join(w for w in plain.split(" ") if w) + " ").encode()
    lengths = []
    for own in (content(scorer.ordinary), content(scorer.toxic) + content(scorer.ordinary)):
        settings = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=5, target_length=0, strategy=1, write_content_size=False, write_dict_id=False)
        known = zstandard.ZstdCompressionDict(own + b"\x7f" + anchor, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        starts, at = [0], 44
        while at + 16 < len(data):
            starts.append(at)
            at += 44
        lengths.append([len(zstandard.ZstdCompressor(dict_data=known, compression_params=settings).compress(data[i : i + 60] + anchor)) for i in starts])
    margins = [a - b for a, b in zip(*lengths) if a > b]
    chance = scorer.saved * len(lengths[0]), scorer.hits * len(lengths[0])
    evidence = (sum(margins) - chance[0]) / math.sqrt(3 * chance[0] + 9) + (len(margins) - chance[1]) / math.sqrt(chance[1] + 0.5)
    return min(1.0, scorer.curve[min(max(math.floor(8 * evidence), 0), 127)] + 0.001 * (1 - 1 / (1 + sum(margins))))


def test_toxicity_scores_are_brute_force(spark):
    some, labels = toxic_rows(300, 11)
    some += [(9000, None, "en", "s", 1), (9001, "", "en", "s", 1), (9002, "Ünïcode ### grobble " * 700, "en", "s", 1)]
    frames = docs.frame(spark, some), spark.createDataFrame(labels, LABELS)
    scorer = toxicity.train(*frames, keep=~toxicity.is_held_out(toxicity.F.col("id")))
    assert scorer.toxic and scorer.ordinary and len(scorer.curve) == 128 and scorer.curve == sorted(scorer.curve)
    texts = {i: t for i, t, *_ in some}
    for r in toxicity.score_toxicity(*frames).collect():
        assert r.score == pytest.approx(plainly_scored(scorer, texts[r.doc_id]), abs=1e-12)


def test_toxicity_thresholds_are_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 120)
    some, labels = toxic_rows(1500, 13)
    some += [(8000, some[0][1], "en", "s", 1), (8000, "twice", "en", "s", 1)]
    frame, keep = docs.frame(spark, some), ~toxicity.is_held_out(toxicity.F.col("id"))
    scorer = toxicity.train(frame, spark.createDataFrame(labels, LABELS), keep=keep)
    texts, truth = {i: t for i, t, *_ in some}, {i: t for i, _, t, _ in labels}
    got = toxicity.score_toxicity(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(some)
    for r in got:
        if r.doc_id != 8000:
            assert r.score == pytest.approx(plainly_scored(scorer, texts[r.doc_id]), abs=1e-12)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(t and p for t, p in held) >= 0.8 * sum(t for t, _ in held) and sum(p and not t for t, p in held) <= 0.02 * len(held)
    # without the labels outside the sample, the same dictionaries are calibrated otherwise
    learn = spark.createDataFrame([(i, t) for i, _, t, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1], "doc_id long, toxic int")
    by_class = [learn.where(f"toxic = {k}").orderBy(toxicity.F.xxhash64("doc_id"), "doc_id").limit(120) for k in (0, 1)]
    fewer = toxicity.train(frame, by_class[0].unionByName(by_class[1]), keep=keep)
    assert (fewer.toxic, fewer.ordinary) == (scorer.toxic, scorer.ordinary) and fewer.curve != scorer.curve


def test_dictionaries_cover_their_own_class():
    ordinary = [b" the cat sat on a mat %d " % i for i in range(40)]
    toxic = [b" the cat sat grobble on a mat %d " % i for i in range(40)]
    *folds, (plain, marked) = compression.train(toxic, ordinary, 4)
    assert len(folds) == 4 and b" grobble " in marked and not any(b"grob" in s for s in plain)
    counts = compression.held_by(toxic, 4)
    assert counts[-1][b"grobb"] == 40 and all(c[b"grobb"] == 30 for c in counts[:-1])
    assert compression.train([], [], 2) == [([], [])] * 3
    margins = compression.Lengths(plain, marked).margins(b" the cat sat grobble on a mat ")
    assert max(margins) > 0 and compression.Lengths(plain, marked).margins(b" the cat sat on a mat ") == [0]


def test_toxicity_ignores_held_out_labels(spark):
    some, labels = toxic_rows(400, 5)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, c) for i, q, t, c in labels]
    score = lambda l: sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs.frame(spark, some), spark.createDataFrame(l, LABELS)).collect())
    assert score(labels) == score(flipped)


def test_clean_rows_are_carried(spark):
    some, labels = toxic_rows(300, 11)
    some += [(9000, None, "en", "s", 1), (9001, "", None, None, None), (None, "grobble ### grobble", "en", "s", 1), (9001, "", None, None, None)]
    frames = docs.frame(spark, some), spark.createDataFrame(labels, LABELS)
    bad = {r.doc_id for r in toxicity.score_toxicity(*frames).collect() if r.predicted}
    clean = toxicity.keep_clean(*frames)
    assert bad and clean.schema == frames[0].schema
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in frames[0].collect() if r.doc_id not in bad or r.doc_id is None)


def test_toxicity_without_labels(spark):
    got = toxicity.score_toxicity(docs.frame(spark), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(docs.rows()) and {r.predicted for r in got} == {0}
    assert toxicity.score_toxicity(docs.frame(spark, []), spark.createDataFrame([], LABELS)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, VEC_ID string, list int, query_id long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1, 2) for i, v in rows], VECTORS)


def brute_nearest(rows, every=50, top=5):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8:
            good.setdefault(i, []).append(np.asarray(v, np.float32).astype(float))
    out = {}
    for q in (i for i in good if i % every == 0):
        best = {i: max(float(ann.cosines(a[None], b[None])[0, 0]) for a in good[q] for b in own) for i, own in good.items() if i != q}
        out[q] = sorted(best, key=lambda i: (-best[i], i))[:top], best
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[50][1]) for i in range(400)]  # one very common vector
    rows += [(5000, None), (5050, []), (5100, [0.0] * 8), (5150, [float("nan")] * 8), (5200, [1.0, None] * 4), (5250, [float("inf")] * 8), (5300, [1.0] * 7), (None, [1.0] * 8), (100, rows[100][1])]
    want = brute_nearest(rows)
    got = {}
    for r in ann.nearest_neighbours(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for q, (best, scores) in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        found = [got[q][k] for k in range(1, 6)]
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(s == scores[i] for i, s in found)
        hits += sum(s >= scores[best[-1]] for _, s in found)
    assert hits >= 0.9 * 5 * len(want)


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest_neighbours(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest_neighbours(vectors(spark, rows[:1])).collect() == []
    assert ann.nearest_neighbours(vectors(spark, [])).collect() == []
    assert ann.nearest_neighbours(vectors(spark, [(0, None), (50, [0.0, 0.0])])).collect() == []


def test_neighbours_behind_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 10)
    monkeypatch.setattr(ann, "SAMPLE", 40)
    rng = np.random.default_rng(12)
    near = [1.0] + [0.0] * 7
    rows = [(50, near)] + [(1, near)] * 300 + [(i, (-np.abs(rng.normal(size=8))).tolist()) for i in range(2, 40)]
    rows += [(100_000 + i, [0.0] * 8) for i in range(500)]  # unusable vectors must not fill the sample
    got = [(r.vec_id, r.score) for r in ann.nearest_neighbours(vectors(spark, rows)).where("query_id = 50").orderBy("rank").collect()]
    best, scores = brute_nearest(rows)[50]
    assert got == [(i, scores[i]) for i in best]


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(8)
    sample = ann._unit(rng.normal(size=(4000, 16)))
    index = ann.fit(sample, 100, 5)
    lists, d = index.search(sample[:200], 4)
    true = np.argsort(ann._distances(sample[:200], index.centroids), axis=1)[:, 0]
    assert (lists[:, 0] == true).mean() > 0.97
    sizes = np.bincount(index.homes(sample)[1], minlength=100)
    assert sizes.max() < 6 * sizes.mean()


def test_pipeline_stages(spark, tmp_path):
    some, labels = toxic_rows(700, 9)
    some = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in some]
    copies = [(2000 + i, some[i + 1][1], "en", "s0", 1) for i in range(0, 40, 7)]
    near = [(3000 + i, " ".join(["n%d" % k for k in range(120)]) + f" end{i}", "en", "s1", 1) for i in range(9)]
    odd = [(4000, None, None, None, None), (4001, "", "en", "s0", 0), (None, "no id here at all", "en", "s2", 3), (3001, near[1][1], "en", "s1", 1)]
    odd += [(5000, "one text of an id", "en", "s1", 1), (5000, "quite another text of that id", "en", "s1", 2), (None, "a second text without an id", "en", "s2", 3)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(some + copies + near + odd, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x[:3] for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, current, str(tmp_path))
        if k < 4:
            assert result.columns == current.columns
        result.write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(current.collect())
    truth = {i: t for i, _, t, _ in labels}
    ids = [[r.doc_id for r in rows] for rows in kept]
    toxic, clean = [i for i in truth if truth[i]], [i for i in truth if not truth[i]]
    assert len(set(ids[0]) & set(toxic)) <= 0.1 * len(toxic) and len(set(ids[0]) & set(clean)) >= 0.99 * len(clean)
    texts = [r.text or "" for r in kept[1]]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in kept[0]}
    best = {}
    for r in kept[0]:
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert {(r.text or "", -1 if r.doc_id is None else r.doc_id) for r in kept[1]} == set(best.items())
    stays = [str(x[0]) for x in expected_near([(r.doc_id, r.text) for r in kept[1]], 5, 80) if x[3]]
    assert sorted(str(i) for i in ids[2]) == sorted(stays)
    taken = mixing.mix_sources(spark.read.parquet(f"{tmp_path}/2"), carry=True).collect()
    assert len({r.doc_id for r in taken}) < len(taken)  # some rows share an id
    assert sorted(map(str, map(tuple, kept[3]))) == sorted(str(tuple(r.row)) for r in taken for _ in range(r.copies_taken))
    assert sorted(map(str, ids[4])) == sorted(map(str, ids[3])) and all(r.round_trip and r.parity for r in kept[4])


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
