"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, pick, table, words

#: Documents at a pattern's boundary that are chosen one by one; a pattern that has more is cut by its hash first.
BOUNDARY = 4096
SLOTS = 64
#: Rows of one id and text that are numbered by one task, where only some of them are taken.
PIECE = 100_000
#: Sources and membership patterns are counted on the driver; more than this is an error, not a collect.
MAX_PATTERNS = 100_000
TOP = 1 << 60


def water_fill(sizes: list[int], weights: list[float], copies: int) -> list[float]:
    """Shares of the sum of sizes by weight; what is above copies * size goes to the others by weight, again and again."""
    caps = [float(copies * s) for s in sizes]
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / weight > caps[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = caps[i]
        left -= sum(caps[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return out


def min_cost_flow(capacities: list[int], members: list[list[int]], quotas: list[int], copies: int) -> list[int]:
    """Words to take from each pattern: as much as meets the quotas, at the least sum of repetition costs.

    Copy c of a pattern costs c * c a word (convex, so all copies of one kind are used before the next), members are
    the pattern's sources. Patterns that share no source, not even through others, are solved apart.
    """
    parent = list(range(len(quotas)))

    def find(q: int) -> int:
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        return q

    for own in members:
        for q in own[1:]:
            parent[find(q)] = find(own[0])
    groups: dict[int, list[int]] = defaultdict(list)
    for p, own in enumerate(members):
        groups[find(own[0])].append(p)
    out = [0] * len(capacities)
    for patterns in groups.values():
        sources = sorted({q for p in patterns for q in members[p]})
        place = {q: i for i, q in enumerate(sources)}
        flows = _connected_flow([capacities[p] for p in patterns], [[place[q] for q in members[p]] for p in patterns], [quotas[q] for q in sources], copies)
        for p, flow in zip(patterns, flows):
            out[p] = flow
    return out


def _connected_flow(capacities: list[int], members: list[list[int]], quotas: list[int], copies: int) -> list[int]:
    """Successive shortest paths with potentials, on integers."""
    n_p, n_q = len(capacities), len(quotas)
    start, end = n_p + n_q, n_p + n_q + 1
    graph: list[list[list[int]]] = [[] for _ in range(n_p + n_q + 2)]  # edges: to, capacity, cost, index of the way back

    def edge(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, capacity in enumerate(capacities):
        for c in range(copies):
            edge(start, p, capacity, c * c)
        for q in members[p]:
            edge(p, n_p + q, copies * capacity, 0)
    for q, quota in enumerate(quotas):
        edge(n_p + q, end, quota, 0)
    potential = [0] * len(graph)
    while True:
        cost: dict[int, int] = {start: 0}
        via: dict[int, tuple[int, int]] = {}
        heap, done = [(0, start)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for k, (b, capacity, c, _) in enumerate(graph[a]):
                if capacity > 0 and b not in done and (new := d + c + potential[a] - potential[b]) < cost.get(b, 1 << 62):
                    cost[b], via[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if end not in cost:
            taken = [0] * n_p
            for p, _, _, back in graph[start]:
                taken[p] += graph[p][back][1]
            return taken
        furthest = max(cost.values())
        potential = [h + cost.get(a, furthest) for a, h in enumerate(potential)]
        flow, b = 1 << 62, end
        while b != start:
            flow, b = min(flow, graph[via[b][0]][via[b][1]][1]), via[b][0]
        b = end
        while b != start:
            a, k = via[b]
            graph[a][k][1] -= flow
            graph[b][graph[a][k][3]][1] += flow
            b = a


def _fill(rest: dict[int, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def chosen(units: pd.DataFrame) -> pd.DataFrame:
        """First fit in seeded order, as many of a unit's rows as fit; then one more row if that comes nearer."""
        units = units.sort_values(["h", "size"])
        left = rest[int(units["p"].iloc[0])]
        sizes, rows = units["size"].tolist(), units["m"].tolist()
        more = []
        for size, m in zip(sizes, rows):
            more.append(min(m, left // size) if size else m)
            left -= more[-1] * size
        over = [(abs(size - left), i) for i, (size, m) in enumerate(zip(sizes, rows)) if more[i] < m]
        if over and min(over)[0] < left:
            more[min(over)[1]] += 1
        return units.assign(more=pd.Series(more, index=units.index, dtype="int64"))[["p", "h", "size", "m", "more"]]

    return chosen


def _some_of(units: DataFrame) -> DataFrame:
    """Rows of units of which only a part is taken once more: exactly `more` of each unit's rows, numbered in pieces of PIECE rows."""
    unit = ["p", "h", "size"]
    dealt = units.withColumn("piece", F.pmod(F.xxhash64("at"), F.ceil(F.col("m") / PIECE).cast("long")))
    sizes = dealt.groupBy(*unit, "piece").agg(F.count(F.lit(1)).alias("n"), F.first("more").alias("_more"))
    before = F.sum("n").over(Window.partitionBy(*unit).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    quota = sizes.select(*unit, "piece", (F.col("_more") - F.coalesce(before, F.lit(0))).alias("quota"))
    numbered = dealt.join(quota, [*unit, "piece"]).withColumn("place", F.row_number().over(Window.partitionBy(*unit, "piece").orderBy("at")))
    return numbered.withColumn("more", (F.col("place") <= F.col("quota")).cast("long")).select(*units.columns)


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies: int = 3, seed: int = 7, weight: Callable[[int], float] = lambda i: 1 + i % 3, carry: bool = False
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies_taken; with carry also row, a struct of all columns by position.

    source_col is a string, or an array of strings where sources overlap; a null is a source of its own, the last
    by order. weight gives the weight of the i-th source by code point. size counts words; a null text has none.
    source_size and target are those of the row's source (with several: of the first). No row is taken more than
    copies times, whole rows only. Rows that repeat an id (null ids, too) count one by one; of rows that agree in id and
    text any may be the ones that are taken once more. Rows whose size is 0 are taken 0 words; they have one copy where
    their pattern's words are all taken once or more, or where the cut by hash leaves them inside. Empty tables give no
    rows; other columns are ignored.

    Method: sizes are summed by membership pattern (map-side first, so a source with a third of all rows is a row a
    task) and min_cost_flow routes them to the sources' targets. A pattern takes all its rows k times and a part once
    more: those whose seeded hash is below a bound that level-wise histograms find. The rows in the slot of the
    bound (units: an id and text, with how many rows have them), about BOUNDARY of a pattern, are filled in first-fit by
    one task a pattern. Reruns agree.
    """
    rows = pick(docs, id=id_col, text=text_col, source=source_col)
    if carry:
        names = [f"_c{i}" for i in range(len(docs.columns))]
        rows = pick(docs.toDF(*names).withColumn("_row", F.struct(*names)), id=names[docs.columns.index(id_col)], text=names[docs.columns.index(text_col)], source=names[docs.columns.index(source_col)], row="_row")
    carried = ["row"] if carry else []
    sources = F.col("source") if dict(rows.dtypes)["source"].startswith("array") else F.array("source")
    sources = F.when(F.size(F.coalesce(sources, F.array())) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))
    members = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("s"), F.hex(F.encode(s, "UTF-8"))), F.lit("~")))))
    slim = rows.select("id", words(F.col("text")).alias("size"), F.array_join(members, ",").alias("pattern"), F.pmod(F.xxhash64("id", F.coalesce("text", F.lit("")), F.lit(seed)), F.lit(TOP)).alias("h"), *carried)
    slim = materialise(slim)
    slim = slim.select("*", F.struct("_metadata.file_name", "_metadata.row_index").alias("at"))  # a row's place in the written table

    summed = slim.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(summed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    summed = sorted(summed, key=lambda r: r["pattern"])
    names = sorted({s for r in summed for s in r["pattern"].split(",")})  # hex keeps the order of code points, ~ comes last
    number = {s: i for i, s in enumerate(names)}
    belongs = [[number[s] for s in r["pattern"].split(",")] for r in summed]
    sizes = [0] * len(names)
    for r, b in zip(summed, belongs):
        for s in b:
            sizes[s] += r["words"]
    capacities = [r["words"] for r in summed]
    share = sum(capacities) / sum(sizes) if sum(sizes) else 1.0
    targets = water_fill(sizes, [float(weight(i)) for i in range(len(names))], copies)
    flows = min_cost_flow(capacities, belongs, [round(t * share) for t in targets], copies)

    state = []  # pattern's number, its full copies, words still to take, and the slot [lo, hi) of its bound
    for p, (flow, capacity, r) in enumerate(zip(flows, capacities, summed)):
        k, rest = divmod(flow, capacity) if capacity else (0, 0)
        state.append({"p": p, "pattern": r["pattern"], "k": k, "rest": rest, "n": r["n"], "lo": 0, "hi": TOP if rest else 0})
    spark = docs.sparkSession
    facts = lambda: F.broadcast(spark.createDataFrame([(s["pattern"], s["p"], s["k"], s["lo"], s["hi"], s["p"] in wide) for s in state], "pattern string, p int, k long, lo long, hi long, wide boolean"))
    wide: dict[int, dict] = {}
    while wide := {s["p"]: s for s in state if s["rest"] and s["n"] > BOUNDARY and s["hi"] - s["lo"] >= SLOTS}:
        inside = slim.join(facts(), "pattern").where(F.col("wide") & F.col("h").between(F.col("lo"), F.col("hi") - 1))
        slot = F.expr(f"(h - lo) div ((hi - lo) div {SLOTS})")
        counts = inside.groupBy("p", slot.alias("slot")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).orderBy("p", "slot").collect()  # SLOTS rows a pattern
        slots = defaultdict(list)
        for r in counts:
            slots[r["p"]].append(r)
        for p, s in wide.items():
            step, lo = (s["hi"] - s["lo"]) // SLOTS, s["lo"]
            for r in slots[p]:
                if r["words"] > s["rest"]:
                    s |= {"lo": lo + r["slot"] * step, "hi": lo + (r["slot"] + 1) * step, "n": r["n"]}
                    break
                s["rest"] -= r["words"]
            else:
                s |= {"lo": s["hi"], "n": 0, "rest": 0}

    placed = slim.join(facts(), "pattern").withColumn("more", (F.col("h") < F.col("lo")).cast("long"))
    at_bound = F.col("h").between(F.col("lo"), F.col("hi") - 1)
    units = placed.where(at_bound).groupBy("p", "h", "size").agg(F.count(F.lit(1)).alias("m"))
    filled = units.groupBy("p").applyInPandas(_fill({s["p"]: s["rest"] for s in state}), "p int, h long, size long, m long, more long")
    facts_of = ["id", "size", "p", "k", "more", *carried]
    # only the rows at a bound are shuffled: a few thousand of a pattern
    bound = placed.where(at_bound).drop("more").join(filled, ["p", "h", "size"])
    split = (F.col("more") > 0) & (F.col("more") < F.col("m"))
    taken = placed.where(~at_bound).select(*facts_of).unionByName(bound.where(~split).withColumn("more", (F.col("more") > 0).cast("long")).select(*facts_of))
    taken = taken.unionByName(_some_of(bound.where(split).select(*facts_of, "h", "at", "m")).select(*facts_of))
    taken = taken.withColumn("times", F.col("k") + F.col("more"))
    of_source = spark.createDataFrame([(p, sizes[b[0]], targets[b[0]]) for p, b in enumerate(belongs)], "p int, source_size long, target double")
    return taken.join(F.broadcast(of_source), "p").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), F.col("times").cast("int").alias("copies_taken"), *carried
    )


def take(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, all their columns, as often as mix_sources takes them."""
    taken = mix_sources(docs, carry=True, **options).where("copies_taken > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies_taken"))))
    return repeated.select(*[F.col(f"row._c{i}").alias(name) for i, name in enumerate(docs.columns)])


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
