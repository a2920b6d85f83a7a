"""Prefix tries, main text of pages and centroid clusters against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lattica.llm import clustering, html_extract, prefix_trie
from lattica.llm.html_extract import candidates, extract_main_text, main_text
from lattica.llm.page_tree import Page

TURNS = "conv_id long, turn long, role string, text string, conv int, CONV_ID int, key string"


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = said.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += p not in kids
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def trie(spark, rows):
    df = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 1, 2, "k") for r in rows], TURNS))
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()))


def test_trie_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = ["a", "bb", "", None, "ccc ccc", "x" * 50_000]
    rows = [(c, t if rnd.random() < 0.9 else rnd.choice([None, 0, t]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(texts)) for c in [*range(0, 40), *range(98, 130), 205, 207, -3, -120, 10**15 + 7] for t in range(rnd.randint(1, 9))]
    rows += rows[:9] + [(None, 0, "user", "no conversation"), (None, None, None, None)]
    assert trie(spark, rows) == trie_by_hand(rows)


def test_long_conversations_and_hot_prefixes(spark):
    long_one = [(300, i, "user", f"t{i % 7}") for i in range(prefix_trie.PATH * 2 + 40)]
    twin = [(301, i, "user", f"t{i % 7}") for i in range(prefix_trie.PATH + 3)] + [(301, 10**6, "user", "other end")]
    same = [(c, t, "user", "hello") for c in range(1000, 1100) for t in range(7)]
    assert trie(spark, long_one + twin + same) == trie_by_hand(long_one + twin + same)


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    bare = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert trie(spark, [(bare, 0, "user", "gone")]) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]


def test_no_conversation_no_node(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []


VECTORS = "vec_id long, embedding array<double>, label int, vector int, VEC_ID int, cluster int"


def clusters_by_hand(rows, k, rounds, dimension):
    kept = [(i, [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * x.as_integer_ratio()[0] // x.as_integer_ratio()[1] for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centroids)), key=lambda c: (square(v, centroids[c]), c))
    for _ in range(rounds):
        home = [near(v) for _, v in kept]
        for c in set(home):
            own = [v for (_, v), h in zip(kept, home) if h == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, near(v), square(v, centroids[near(v)])) for i, v in kept]
    inside = Counter()
    for _, c, d in out:
        inside[c] += d
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, fits(d), fits(inside[c]), fits(sum(inside.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def clustered(spark, rows, **options):
    return in_order(clustering.cluster(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS), **options).collect())


def test_clusters_equal_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, np.round(rnd.normal(size=8), 1 if i % 3 else 4).tolist()) for i in range(300)]
    rows += rows[:20] + [(7, rows[30][1]), (None, rows[1][1]), (None, rows[2][1]), (900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [None] + [1.0] * 7), (905, [float("nan")] + [1.0] * 7), (906, [float("inf")] + [0.0] * 7), (907, [0.0] * 8), (908, [-0.0] * 8)]
    assert clustered(spark, rows, dimension=8, clusters=12, rounds=4) == in_order(clusters_by_hand(rows, 12, 4, 8))


def test_numbers_beyond_64_bits_stay_exact(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.normal(size=4) * 10.0 ** rnd.integers(-3, 12)).tolist()) for i in range(60)] + [(100, [1e30, -1e30, 3.4e38, 0.0]), (101, [1e308, 0.0, 1.0, -1e308]), (102, [5e306, 1e-320, 1.0, 2.0])]
    assert clustered(spark, rows, dimension=4, clusters=6, rounds=3) == in_order(clusters_by_hand(rows, 6, 3, 4))


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.5, 1.5]), (2, [2.0, 0.0])]
    assert clustered(spark, rows, dimension=2, clusters=40) == in_order(clusters_by_hand(rows, 40, 5, 2))
    assert clustered(spark, [], dimension=2) == [] and clustered(spark, [(1, None)], dimension=2) == []


@pytest.mark.parametrize("scale", [3, 1000, 2**24])
def test_intervals_hold_and_overlaps_are_recomputed(scale):
    rnd = np.random.default_rng(scale)
    centroids = rnd.integers(-scale, scale, (40, 64))
    centroids[7] = centroids[3]  # a tie for everyone
    centroids[9] = centroids[3]
    centroids[9, 0] += 1  # next to a tie
    vectors = np.concatenate([rnd.integers(-scale, scale, (500, 64)), centroids, centroids[[3]] + rnd.integers(-1, 2, (200, 64))])
    a = clustering.Assigner([[int(x) for x in c] for c in centroids])
    exact = ((vectors[:, None, :] - a.whole[None]) ** 2).sum(axis=2)
    some = a.shortlist(vectors)
    assert (some & (exact == exact.min(axis=1, keepdims=True))).sum(axis=1).tolist() == (exact == exact.min(axis=1, keepdims=True)).sum(axis=1).tolist()
    assert some.sum(axis=1).mean() < 8
    near, distance = a.assign(vectors)
    assert near.tolist() == exact.argmin(axis=1).tolist() and distance.tolist() == exact.min(axis=1).tolist()


SITE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>"</script></head><body class="no-sidebar">
<div><div>Menu of the site</div><ul><li><a href="/%d">Home</a><li><a>News</a></ul></div>
<div><h1>Title %d</h1><p>First &amp; only   paragraph
 of page %d<p>A passage that all pages share, <b>word</b> for word<br>and line for line.</div>
<div>Imprint &copy; the owners of this site, all of them</div></body></html>"""


def expected(i):
    return f"Title {i}\n\nFirst & only paragraph of page {i}\n\nA passage that all pages share, word for word and line for line."


def extracted(spark, rows):
    df = extract_main_text(spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, k0 int"))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    out = [tuple(r) for r in df.collect()]
    assert all(n == len(t) for *_, t, n in out)
    return {r[0]: r[2] for r in out}


def test_what_recurs_on_a_host_is_cut(spark):
    rows = [(i, f"https://user@Big.example.com:80/p/{i}", SITE % (i, i, i)) for i in range(12)]
    rows += [(50 + i, f"http://small.example.com/{i}", SITE % (i, i, i)) for i in range(2)]
    rows += [(70 + i, "not a url", SITE % (i, i, i)) for i in range(7)] + [(90, None, SITE % (1, 1, 1)), (91, "http://big.example.com/", None), (92, "http://big.example.com/", ""), (None, "http://big.example.com/", "x")]
    rows += [(100, "//big.example.com?x", "<div>Menu of the site</div>" * 3), (101, "//big.example.com?x", "<div>Menu of the site</div><div>Imprint &copy; the owners of this site, all of them</div>")]
    got = extracted(spark, rows)
    assert [got[i] for i in range(12)] == [expected(i) for i in range(12)]
    menu, imprint = "Menu of the site\n\n", "\n\nImprint © the owners of this site, all of them"
    assert all(got[50 + i] == menu + expected(i) + imprint for i in range(2)) and all(got[70 + i] == menu + expected(i) + imprint for i in range(7))
    assert got[90] == menu + expected(1) + imprint and got[91] == got[92] == "" and got[None] == "x"
    assert got[100] == "\n\n".join(["Menu of the site"] * 3)  # nothing else would be left
    assert got[101] == imprint.strip()  # half of a page is no template


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "http://a.example/", SITE % (1, 1, 1))] * 30
    assert len(extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == 30
    assert "Menu of the site" in extracted(spark, rows)[1]  # one page, however often it is in the table
    assert extracted(spark, []) == {}


def test_copies_of_an_article_stay(spark):
    article = "<article><h1>T</h1>" + "".join(f"<section><h2>S{k}</h2><p>Text of section {k}.</p></section>" for k in range(4)) + "</article>"
    rows = [(i, f"http://a.example/{i}", f"<div>Ad number {i}</div>{article}<div>Foot</div>") for i in range(20)]
    rows += [(100 + i, f"http://a.example/o{i}", f"<article><p>Other {i}</p><section><p>Buy our book</p></section></article><div>Foot</div>") for i in range(6)]
    got = extracted(spark, rows)
    whole = "T\n\n" + "\n\n".join(f"S{k}\n\nText of section {k}." for k in range(4))
    assert all(got[i] == whole for i in range(20))
    assert all(got[100 + i].startswith(f"Other {i}") for i in range(6))


def test_counts_equal_brute_force(spark):
    data = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{data}/pages.parquet")
    own = defaultdict(set)
    hosts = defaultdict(set)
    for r in pages.withColumn("host", html_extract.host_of(pages["url"])).collect():
        main, at = candidates(*(lambda p: (p, p.removed()))(Page(r["html"])))
        hosts[r["host"]].add(main)
        for h in at:
            own[r["host"], h].add(main)
    want = {k for k, v in own.items() if len(v) >= 3 and 20 * len(v) >= len(hosts[k[0]])}
    rows = pages.withColumn("host", html_extract.host_of(pages["url"])).select(*html_extract._same("host", "html"), "host", "html").mapInArrow(html_extract._counted, "k0 long, k1 long, host string, main long, trees array<long>")
    assert want and {tuple(r) for r in html_extract.templates(rows, 3, 20).collect()} == want


def test_articles_of_the_test_pages(spark):
    import html
    import re

    for r in html_extract.op12_html_extraction(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|ul|li)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a <b>b</b>\n c<p>d&amp;e&nbsp;x<div>f<span>g</span><br>h</div>tail", "a b c\n\nd&e x\n\nfg h\n\ntail"),
        ("a < b &lt; c <3 <!-- x > y --> d <script>var a='</p>'</SCRIPT >e<textarea><b></textarea>", "a < b < c <3 d e"),
        ("<main><h1>T</h1><article><header><h2>H</h2></header><p>x</p><aside>y</aside><div class='ad-box'>z</div><footer>f</footer></article></main>out", "T\n\nH\n\nx"),
        ("<body><header>S</header><div class=post>one<p>two</div><section id=reader-comments><article class=comment>c</article></section><form>q</form>", "one\n\ntwo"),
        ("<form><article><p>in a form<button>b</button></article></form>", "in a form"),
        ("<p class='cookieNotice'>n</p><p class='entry-content'>e</p><div class='page with-sidebar'>p</div><div role=navigation>m</div><p hidden>h</p><p title='a hidden b'>t</p>", "e\n\np\n\nt"),
        ("<table><tr><td>a<td>b</td><tr><th>c<p>d</table>", "a b\n\nc\n\nd"),
        ("<ul><li>1<ul><li>1.1</ul><li>2</ul></b></p>x", "1\n\n1.1\n\n2\n\nx"),
        ("<p>open <a href='x>y", "open y"),
        ("<p>open <a href=x", "open"),
        ("<div><a>Home</a> | <a>News</a></div><div><p>text <a>with</a> <a>links</a> and words enough</div><ul><li><a>x</a><li><a>y</a></ul>", "text with links and words enough"),
        ("<article>text<ul><li><a>x</a><li><a>y</a></ul></article>", "text\n\nx\n\ny"),
        ("<ul><li><a>only</a><li><a>links</a></ul>", "only\n\nlinks"),
        ("<div>text of the page<p class=copyright>c</p></div>", "text of the page"),
        ("<p>a<!-- never closed <p>b", "a"),
        ("<A HREF=x>Link</A></div></article> text <?php x ?> <![CDATA[c]]>z", "Link text z"),
        ("", ""),
        ("&#65;&#x42;&eacute;&unknown;&amp", "ABé&unknown;&"),
    ],
)
def test_broken_and_odd_markup(source, text):
    assert main_text(source, []) == text


@pytest.mark.parametrize("source", ["<b>" * 20_000 + "<p>" * 20_000, "<div>" * 50_000 + "x", '<a b="' * 50_000, "<a " * 100_000, "<" * 200_000, "<p>" * 50_000 + "</b>" * 5000, "<p>" + "word " * 400_000])
def test_long_and_deep_pages_take_linear_time(source):
    page = Page(source)
    candidates(page, page.removed())
    assert main_text(source, []) == " ".join(source[3:].split()) if source.startswith("<p>w") else True
