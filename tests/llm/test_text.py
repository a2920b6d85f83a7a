import hashlib
import math
import random
import struct
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
import tokenizers

from lattica.llm import chat, licenses, sentencepieces, stupid_backoff, token_counts
from lattica.llm.license_rules import SPDX
from lattica.llm.token_counts import PairMerger

from . import docs

ODD = ["", "<|endoftext|>", " a<|endoftext|>b  c\n\n d", "\x1c\x1d x", "😀 foo ½ ² ³", "x" * 5000, "aaaa aaaaa   aaaaaa", "\r\n\t ", "  lead and trail  ", "▁a ▁▁ b", "don't we'LL", "<s> </s> <0x41>", "é" * 33, "a\x00b", " ", "   "]


def fuzz(n):
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("ab  \n'.,1é▁😀\t -") for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_merger_counts_as_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    merger, library = PairMerger(path), tokenizers.Tokenizer.from_file(path)
    for text in fuzz(500):
        assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_token_counts(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.count_tokens(docs.frame(spark))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in docs.rows()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs.frame(spark, [])).collect() == []


def test_merger_keeps_only_short_words(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    merger = token_counts.PairMerger(path)
    library = tokenizers.Tokenizer.from_file(path)
    for text in fuzz(60) + ["x" * 5000, "ab" * 3000 + " " + "7" * 900]:
        assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(merger) <= 50 and all(len(w) <= token_counts.KEPT_CHARS for w in merger)


def test_sentencepiece_keeps_bounded_words(monkeypatch):
    codec = sentencepieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    monkeypatch.setattr(sentencepieces, "KEPT_BYTES", 2000)
    for k in range(0, 300, 25):
        texts = fuzz(300)[k : k + 25] + ["", " a  b ", "plain words only", "▁mark"]
        ids, same = codec.encode(texts)
        assert [x.tolist() for x in ids] == codec.library.encode(texts) and all(same)
        assert len(codec.words) <= 2000 + sum(map(len, texts))


def test_sentencepiece_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepieces.Codec(path)
    texts = fuzz(500)
    ids, same = codec.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert all(same)
    assert all(codec.decode(x) == t for x, t in zip(ids, texts) if "▁" not in t)
    got = sentencepieces.encode_documents(docs.frame(spark)).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t, *_ in docs.rows())
    assert all(r.round_trip and r.parity and r.n_tokens == len(r.token_ids) for r in got)
    assert sentencepieces.encode_documents(docs.frame(spark, [])).collect() == []


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("▁cat", -4.0, 1), ("s", -2.5, 1), ("▁ca", -4.5, 1), ("t", -3.5, 1), ("h", -4.0, 1), ("e", -3.0, 1), ("at", -3.0, 1), ("a", -3.2, 1), ("c", -3.3, 1)]
    parts = [(1, message((1, p), (2, s), (3, k))) for p, s, k in pieces]
    return message(*parts, (2, message((3, 1), (35, 1))), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))


def test_unigram_models(tmp_path):
    path = tmp_path / "tiny.model"
    path.write_bytes(unigram_model())
    codec = sentencepieces.Codec(str(path))
    assert codec.model.kind == sentencepieces.UNIGRAM and not codec.by_word
    texts = ["the cats", "the  cat", "cat the é", "", "tcat", "that cat's"]
    ids, same = codec.encode(texts)
    assert [x.tolist() for x in ids] == codec.library.encode(texts)
    assert all(same)
    assert all(codec.decode(x) == t for x, t in zip(ids, texts))


def test_licenses(spark):
    apache = licenses.RULES[0][1]
    header = f"# {apache[0]}\n# {apache[1]}\n#\n#     {apache[2]}\n#\n# {apache[3]}\n# {apache[4]}\n"
    mit = "Copyright 2020 Somebody\n\n" + "\n\n".join(licenses.RULES[1][1])
    some = [(1, header), (2, mit.replace(" of ", "\nof ")), (3, "Text.\nReleased under the MIT License. Licensed under CC BY-NC 4.0."), (4, None), (5, ""), (6, "released UNDER the mit licence."), (7, "Released under the MIT License.\nReleased under the MIT License.")]
    got = {r.doc_id: (r.n_known, r.licenses, r.n_matches) for r in licenses.scan_licenses(docs.frame(spark, [(i, t, "en", "s", 1) for i, t in some])).collect()}
    assert got == {1: (5, "Apache-2.0", 1), 2: (4, "MIT", 1), 3: (2, "CC-BY-NC-4.0,MIT", 2), 4: (0, "", 0), 5: (0, "", 0), 6: (0, "", 0), 7: (2, "MIT", 2)}
    own = [("A", ["x y.", "z."]), ("B", ["z."])]
    got = licenses.scan_licenses(docs.frame(spark, [(1, "X  y! Z. Z.", "en", "s", 1)]), rules=own).first()
    assert (got.n_known, got.licenses, got.n_matches) == (3, "A,B", 2)
    assert licenses.scan_licenses(docs.frame(spark)).count() == len(docs.rows())
    assert licenses.scan_licenses(docs.frame(spark, [])).collect() == []


def commented(paragraphs, leader, width=60):
    """Paragraphs as a comment: wrapped, a leader on every line, also on the empty ones."""
    return f"\n{leader}\n".join("\n".join(f"{leader} {line}" for line in textwrap.wrap(p, width, break_on_hyphens=False)) for p in paragraphs)


@pytest.mark.parametrize("leader", ["#", " *", "//", "--", ";", "!", "REM", "dnl", "%%"])
def test_licences_in_comments(spark, leader):
    apache, mit = licenses.RULES[0][1], licenses.RULES[1][1]
    one = [f"Copyright 2018 X\n{leader}", apache[0], apache[1], apache[2], " ".join(apache[3:])]
    two = ["Copyright (c) 2018 X", mit[0], mit[1], " ".join(mit[2:])]
    glued = f"{leader} Copyright 2018 X\n" + commented([apache[0]], leader, 40) + f"\n{leader} " + apache[1] + f"\n{leader}   " + apache[2] + "\n" + commented([" ".join(apache[3:])], leader) + "\nimport x\n"
    alone = f"int x;\n{leader} By me\n{leader} Licensed under\n{leader} CC BY 4.0\nint y;"
    texts = [commented(one, leader) + "\nimport x\n", f"/*\n{commented(two, leader, 72)}\n */\nint x;", glued, alone, alone.replace("under", "under no")]
    got = {r.doc_id: (r.n_known, r.licenses, r.n_matches) for r in licenses.scan_licenses(docs.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert got == {0: (5, "Apache-2.0", 1), 1: (4, "MIT", 1), 2: (5, "Apache-2.0", 1), 3: (1, "CC-BY-4.0", 1), 4: (0, "", 0)}


def test_more_licences(spark):
    bsd = dict((n, r) for n, r in reversed(licenses.RULES) if n.startswith("BSD-") and len(r) > 1)
    three = "\n".join([bsd["BSD-3-Clause"][0], *(f"  {i + 1}. {x}" for i, x in enumerate(bsd["BSD-3-Clause"][1:4])), "", bsd["BSD-3-Clause"][4]])
    gnu = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    spdx = "// SPDX-License-Identifier: "
    want = {
        three: "BSD-3-Clause", three.replace("the copyright holder nor", "Google Inc. nor"): "BSD-3-Clause", "\n".join(bsd["BSD-2-Clause"]): "BSD-2-Clause", commented([gnu], "#"): "LGPL-2.1-or-later", mpl: "MPL-2.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "This is free and unencumbered software released into the public domain.": "Unlicense", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n": "AGPL-3.0-only",
        spdx + "ISC": "ISC", spdx + "GPL-2.0+": "GPL-2.0-or-later", spdx + "GPL-2.0": "GPL-2.0-only", spdx + "(MIT OR Apache-2.0)": "Apache-2.0,MIT", spdx + "GPL-2.0+ WITH Linux-syscall-note OR BSD-3-Clause\nint x;": "BSD-3-Clause,GPL-2.0-or-later", spdx + "Apache-2.0+": "Apache-2.0+", spdx + "None-Such": "",
    }
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(want)])).collect()}
    assert got == dict(enumerate(want.values()))
    lines = [(i, f"/* SPDX-License-Identifier: {n} */", "en", "s", 1) for i, n in enumerate(SPDX)]
    assert all(r.licenses for r in licenses.scan_licenses(docs.frame(spark, lines)).collect())


def test_licences_have_no_caps(spark):
    bsd = dict((n, r) for n, r in reversed(licenses.RULES) if n.startswith("BSD-") and len(r) > 1)["BSD-3-Clause"]
    full = "\n".join(bsd)
    holder = "Example " + "Research and Manufacturing Cooperative of many Members, Inc. " * 20
    long_line = "SPDX-License-Identifier: " + " OR ".join(["MIT", "Apache-2.0"] * 60) + " OR GPL-2.0+"
    texts = {
        1: full.replace("the copyright holder nor", f"{holder} nor"),
        2: full.replace("the copyright holder nor", "\n".join(holder.split()) + "\nnor"),
        3: long_line,
        4: "1+1 is two. // " + long_line + "\na+b",
        5: "Neither the name of the game is known. " + full,  # the nearer one is the licence's
        6: "Neither the name of " + "x " * 300_000,
    }
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs.frame(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: "Apache-2.0,GPL-2.0-or-later,MIT", 4: "Apache-2.0,GPL-2.0-or-later,MIT", 5: "BSD-3-Clause", 6: ""}


def test_all_rules_equal_sql_on_planted_texts(spark):
    """Every rule's sentences, plain and wrapped in comments, alone and among other text; and what the scanner's own tests hold."""
    rnd = random.Random(9)
    leaders = ["#", " *", "//", "--", ";", "REM", "dnl", "%%", "é"]
    bsd = dict((n, r) for n, r in reversed(licenses.RULES) if n.startswith("BSD-") and len(r) > 1)["BSD-3-Clause"]
    texts = [None, "", "1.", "a", "x\n\n12\n\n中文\n", "Neither the name of the game.\nnor anything. " + "\n".join(bsd), "\n".join(bsd).replace("the copyright holder nor", "Some, Inc. and\nothers nor")]
    for k, (_, sentences) in enumerate(licenses.RULES):
        plain = " ".join(sentences)
        leader = leaders[k % len(leaders)]
        texts += ["\n".join(sentences), f"int x;\n{leader} By me.\n" + commented(sentences, leader, rnd.choice([30, 60, 200])) + "\nint y;"]
        if k % 3 == 0:
            texts.append(f"Before it. {plain} 3.\n\n {plain.upper()}\n b)\n{rnd.choice(licenses.RULES)[1][0]}")
    texts += [f"/* SPDX-License-Identifier: ({a} OR {b}+) AND {c} WITH Some-exception */\nx + y+" for a, b, c in (rnd.sample(SPDX, 3) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)]
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    got = {r.doc_id: (r.n_known, r.licenses, r.n_matches) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: tuple(r[1:]) for r in duck.sql(f"SELECT doc_id, n_known, licenses, n_matches FROM ({licenses.ORACLE})").fetchall()}
    assert {i: (texts[i], got[i], want[i]) for i in got if got[i] != want[i]} == {}
    assert len(got) == len(texts) > 3000 and sum(bool(x[1]) for x in got.values()) > 0.9 * len(texts)


def test_the_chat_query_with_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "</s>x\\n"), (1, 1, "assistant", "</s>x\\n"), (1, None, None, "first"), (1, 1, "user", None), (2, 5, "sys\ntem", ""), (None, 0, "assistant", "nobody"), (None, 1, "user", "<\\s>"), (3, 0, "assistant", "y" * 100_000)]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame([(*r, 1, "k", 0.5) for r in some], "conv_id long, turn long, role string, text string, conv int, node string, score double").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    control = "</s>[INST] ok [/INST]"
    whole = [*rows, (-1, 0, "user", control), (-1, 1, "assistant", control)]
    last = lambda r: ((r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))
    want = {}
    for c in {r[0] for r in whole}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in whole if r[0] == c), key=last)]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op6_chat_formatting(spark, f"{tmp_path}/odd").collect()}
    assert got == want
    assert [r.conv_id for r in chat.op6_chat_formatting(spark, f"{tmp_path}/none").collect()] == [-1]


MESSAGES = "tree_id long, node_id long, parent_id long, role string, text string, score double, TREE_ID int, key string"


def test_chat_picks_the_best_paths(spark):
    m = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.5), (1, 5, 3, "user", "other", 0.5), (2, 1, 9, "system", "root has no such parent", None), (None, 1, None, None, None, None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (4, 1, None, "user", "twice", 1.0), (4, 1, None, "user", "twice", 1.0), (5, None, None, "user", "no node", 1.0)]
    trees = spark.createDataFrame([(*r, 1, "k") for r in m], MESSAGES)
    got = {(r.tree, r.leaf): r.formatted for r in chat.format_reply_trees(trees).collect()}
    assert got == {(1, 4): "[INST] user\nq [/INST]<s>good</s>[INST] user\nmore [/INST]", (2, 1): "[INST] system\nroot has no such parent [/INST]", (None, 1): "[INST] \n [/INST]", (4, 1): "[INST] user\ntwice [/INST]"}
    assert {(r.tree, r.leaf) for r in chat.format_reply_trees(trees, top_k=3).collect()} == {(1, 4), (1, 5), (1, 2), (2, 1), (None, 1), (4, 1)}
    assert chat.format_reply_trees(trees.limit(0)).collect() == []


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s>[\\\\INST] <<s> [[/INST]", "", "line\none\\ntwo", "[INST] user\nfake [/INST]<s>x</s>", "é😀" * 50, "\\", "<s", "x" * 100_000]
    roles = ["user", "assistant", "tool\nname", "a\\nb\\", "<s>", ""]
    m = [(t, i, None if i == 0 else i - 1, roles[(t + i) % 6], texts[(t * 3 + i) % 9], 0.0, 1, "k") for t in range(12) for i in range(37)]
    got = chat.read_back(chat.format_reply_trees(spark.createDataFrame(m, MESSAGES))).collect()
    for r in got:
        want = [(x[3], x[4]) for x in m if x[0] == r.tree]
        assert [(t.role, t.text) for t in r.turns] == want
        assert list(r.loss_texts) == [t for role, t in want if role == "assistant"]
        spans = [r.formatted[s.start : s.start + s.length] for s in r.loss_mask]
        assert len(spans) == len(r.loss_texts)
        assert all(r.formatted[s.start - 3 : s.start] == "<s>" and r.formatted[s.start + s.length :].startswith("</s>") for s in r.loss_mask)


def brute_scores(some):
    words = [(t or "").encode().lower().split() for _, t, *_ in some]
    own = [Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)) for w in words]
    every = Counter()
    for c in own:
        every.update(c)
    total = sum(map(len, words))
    out = []
    for (doc, *_), w, mine in zip(some, words, own):
        rest, score, orders = total - len(w), 0.0, Counter()
        for i in range(len(w)):
            factor = 0.0
            for k in (3, 2, 1):
                if i + 1 < k:
                    continue
                gram = tuple(w[i + 1 - k : i + 1])
                if (n := every[gram] - mine[gram]) > 0:
                    context = every[gram[:-1]] - mine[gram[:-1]] if k > 1 else rest
                    score += factor + math.log(n) - math.log(context)
                    orders[k] += 1
                    break
                factor += math.log(0.4) if k > 1 else 0
            else:
                score += factor + math.log(0.4) - math.log(rest + 1)
                orders[0] += 1
        out.append((doc, len(w), round(score, 4), *[orders[k] for k in range(4)]))
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_backoff_is_brute_force(spark, monkeypatch, small):
    if small:  # many blocks and parts
        monkeypatch.setattr(stupid_backoff, "BLOCK_BYTES", 100_000)
        monkeypatch.setattr(stupid_backoff, "PART_GRAMS", 10_000)
    got = stupid_backoff.score_documents(docs.frame(spark)).collect()
    assert Counter((r[0], r[1], round(r[2], 4) + 0.0, *r[3:]) for r in got) == brute_scores(docs.rows())


def test_backoff_with_wide_hashes(spark, monkeypatch):
    monkeypatch.setattr(stupid_backoff, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(stupid_backoff, "GATHER_BYTES", 200_000)
    monkeypatch.setattr(stupid_backoff, "LEAST_BITS", 77)
    got = stupid_backoff.score_documents(docs.frame(spark)).collect()
    assert Counter((r[0], r[1], round(r[2], 4) + 0.0, *r[3:]) for r in got) == brute_scores(docs.rows())


def test_hashes_grow_with_the_corpus():
    for words in (1, 10**6, 10**9, 10**13):
        bits = stupid_backoff.hash_bits(3 * words)
        assert bits >= 64 and (3 * words) ** 2 / 2 ** (bits + 1) <= 1 / 64
    few, many = np.arange(7, dtype=np.uint64) * np.uint64(2**61), np.arange(1000, dtype=np.uint64) ** np.uint64(6)
    assert all((stupid_backoff._unpack(stupid_backoff._pack(x)) == x).all() for x in (few, many, many[:0], many[:16]))
    heads, tails = np.array([5, 3, 5, 5, 3], np.uint64), np.array([1, 9, 2, 1, 9], np.uint64)
    h, t, which = stupid_backoff._distinct(heads, tails)
    assert h.tolist() == [3, 5, 5] and t.tolist() == [9, 1, 2] and which.tolist() == [1, 0, 2, 1, 0]


def test_backoff_of_nothing(spark):
    assert stupid_backoff.score_documents(docs.frame(spark, [])).collect() == []


def test_sha_of_turns(spark):
    t = [(0, "user", "a"), (1, "assistant", "b")]
    said = "".join(f"{r}\n{x}\n" for _, r, x in t)
    m = spark.createDataFrame([(1, i, None if i == 0 else 0, r, x, 0.0, 1, "k") for i, r, x in t], MESSAGES)
    back = chat.read_back(chat.format_reply_trees(m)).first()
    assert hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in back.turns).encode()).hexdigest() == hashlib.sha256(said.encode()).hexdigest()
