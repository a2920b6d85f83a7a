"""Main text of web pages: subtrees that recur over a host's pages are its template and go; what names mark as no article goes, too."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pick, table
from .page_tree import CONTAINERS, Page

#: A subtree is a template if so many different pages of its host have it, and one in so many of them.
LEAST, ONE_IN = 3, 500


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _same(*columns: str) -> list[Column]:
    """128 bits of a page: pages of equal host and html are one page to count."""
    return [F.xxhash64(*columns, F.lit(seed)).alias(name) for seed, name in enumerate(("k0", "k1"))]


def candidates(page: Page, page_gone: bytearray) -> tuple[int, dict[int, list[int]]]:
    """(hash of the main text's elements, elements to count by their subtrees' hash).

    To count are elements that hold other blocks or stand for themselves, such as div, section, list or nav. Half of the
    main text or more is no template, however often it recurs, unless most of it is links.
    """
    hashes, letters = page.hashes(), page.letters()
    linked = page.letters(linked=True)
    mains = [e for e in range(len(page.names)) if page.in_main[e] and not (page.parents[e] >= 0 and page.in_main[page.parents[e]]) and not page_gone[e]]
    whole = sum(letters[e] for e in mains) if mains else max(1, letters[0] - sum(letters[e] for e in range(1, len(page.names)) if page_gone[e] and not page_gone[page.parents[e]]))
    at: dict[int, list[int]] = {}
    for e in range(1, len(page.names)):
        if page.names[e] in CONTAINERS and hashes[e] and not page.holds[e] and (page_gone[e] or 2 * letters[e] < whole or 2 * linked[e] > letters[e]):
            at.setdefault(hashes[e] - 2**63, []).append(e)
    main = 0
    for e in mains or [0]:
        main = (main * 1_000_003 + hashes[e]) % 2**64
    return main - 2**63, at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [candidates(page, page.removed()) for page in map(Page, part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([m for m, _ in found], pa.int64()), pa.array([list(h) for _, h in found], pa.list_(pa.int64()))], ["k0", "k1", "host", "main", "trees"])


def main_text(source: str, cut: list[int]) -> str:
    """The page's blocks, by two newlines, without subtrees whose hashes are in cut."""
    page = Page(source)
    gone = page.removed()
    left = any(name in CONTAINERS and not gone[e] and not page.holds[e] for e, name in enumerate(page.names))
    if not cut or not left:
        return "\n\n".join(page.blocks(gone))
    _, at = candidates(page, gone)
    without = bytearray(gone)
    for h in cut:
        for e in at.get(h, ()):
            without[e] = 1
    for e in range(1, len(without)):
        without[e] |= without[page.parents[e]]
    return "\n\n".join(page.blocks(without) or page.blocks(gone))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(s.as_py(), c.as_py() or []) for s, c in zip(part.column(2), part.column(3))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def templates(trees: DataFrame, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(host, tree) of subtrees that recur, from (host, main, trees): pages whose main text is the same count once."""
    pages = trees.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = trees.select("host", "main", F.explode("trees").alias("tree")).distinct().groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.join(pages, "host").where(F.col("n") * one_in >= F.col("pages")).select("host", "tree")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A subtree's hash is of its element names and texts. It is counted over the host's pages, and one that at least
    `least` pages of different main text hold, and one in `one_in`, is deleted. So are elements that their names, roles or
    classes mark as menus, heads, feet, sidebars, notices, adverts, forms or comments. What is left of the outermost
    article and main elements (of the whole page, where there are none) is the text: character references decoded, white
    space within a block one space, blocks joined by two newlines. A page of which templates alone are left keeps them.

    A null html is empty and gives an empty text. Rows are on their own apart from the counts: repeated rows each give a
    row, null ids and urls stay null; pages without a host have no template. Other columns are ignored; an empty
    table gives no rows. Broken markup is read as browsers do: what is open ends with what holds it.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("url", F.col("url").cast("string")).withColumn("html", F.coalesce(F.col("html").cast("string"), F.lit(""))).withColumn("host", host_of(F.col("url")))
    kind = dict(rows.dtypes)["page_id"]
    read = rows.where("host <> ''").select(*_same("host", "html"), "host", "html").mapInArrow(_counted, "k0 long, k1 long, host string, main long, trees array<long>")
    trees = materialise(read.dropDuplicates(["k0", "k1"]))
    held = trees.select("k0", "k1", "host", F.explode("trees").alias("tree")).join(templates(trees, least, one_in), ["host", "tree"], "left_semi")
    cut = held.groupBy("k0", "k1").agg(F.collect_set("tree").alias("cut"))
    keyed = rows.select("page_id", "url", "html", *_same("host", "html"))
    return keyed.join(cut, ["k0", "k1"], "left").select("page_id", "url", "html", "cut").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
