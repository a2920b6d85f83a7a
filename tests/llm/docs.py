"""Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, id int, key string, _c0 int"


def rows(n=60, seed=3):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    out = []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 40)))
        out.append((i, text, "en", f"s{i % 4}", len(text)))
    base = " ".join(rnd.choice(words) + str(k) for k in range(80))
    out += [(100 + i, base + " " + " ".join(f"tail{i}x{j}" for j in range(i % 5)), "en", "s0", 1) for i in range(12)]
    out += [(200, base, "en", "s1", 1), (201, base, None, None, None), (200, base, "en", "s1", 1)]
    out += [(300, None, "en", "s2", 0), (301, "", None, "s2", 0), (302, "   \t\n ", "en", None, 5), (303, "one", "en", "s3", 3), (304, "one two", "en", "s3", 7)]
    out += [(None, "a row without an id", "en", "s1", 19), (None, None, None, None, None), (None, "a row without an id", "en", "s1", 19)]
    out += [(400, "long " + " ".join(f"w{k % 997}" for k in range(60_000)), "en", "s2", 1), (401, "x" * 200_000, "en", "s2", 1)]
    return out


def frame(spark, some=None):
    some = rows() if some is None else some
    return spark.createDataFrame([(*r, "clash", 7, "k", 1) for r in some], SCHEMA)
