"""Graphs of terms: degrees, rows for display, walks, confluence, components, communities, bridges, cliques."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def degree_filter(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges both of whose nodes are seen in at least so many edges."""
    kept = degrees(edges).where(F.col("degree") >= least).select("node")
    return edges.join(kept, edges.src == kept.node, "left_semi").join(kept, edges.dst == kept.node, "left_semi")


def node_rows(cooc: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Nodes for display: number from 0 by term, size from the diagonal, place on sine and cosine, cluster."""
    d = cooc.where("x = y").select(F.col("x").alias("label"), F.col("n").alias("size"))
    out = d.withColumn("id", F.row_number().over(Window.orderBy("label")) - 1)  # the term list's own size
    out = out.select("id", "label", "size", F.sin(F.col("id").cast("double")).alias("x"), F.cos(F.col("id").cast("double")).alias("y"))
    return out if clusters is None else out.join(clusters, "label", "left")


def walk(edges: DataFrame, starts: DataFrame, steps: int, *, loops: bool = False) -> DataFrame:
    """(start, node, p): where a walker is after some steps from each start (node), each edge of a node equally likely.

    One equi-join and one sum a step; probabilities of the same place are added before the next step.
    """
    adjacent = both_ways(edges.select("src", "dst")).distinct()
    if loops:
        nodes = adjacent.select("src").distinct()
        adjacent = adjacent.unionByName(nodes.select("src", F.col("src").alias("dst"))).distinct()
    adjacent = adjacent.join(adjacent.groupBy("src").agg(F.count("*").alias("deg")), "src")
    at = starts.select(F.col("node").alias("start"), "node", F.lit(1.0).alias("p"))
    for _ in range(steps):
        at = at.join(adjacent, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.sum(F.col("p") / F.col("deg")).alias("p"))
    return at


def confluence(edges: DataFrame, steps: int = 3) -> DataFrame:
    """(x, y, value) in 0..1 for every pair that a walk reaches: the walk's probability against that of the degrees alone, c = p / (p + limit)."""
    pairs = both_ways(edges.select("src", "dst")).distinct()
    nodes = pairs.select(F.col("src").alias("node")).distinct()
    deg = pairs.groupBy(F.col("src").alias("node")).agg((F.count("*") + 1).alias("d"))
    total = deg.agg(F.sum("d").alias("all"))
    p = walk(edges, nodes, steps, loops=True)
    limit = p.join(deg, "node").crossJoin(F.broadcast(total))
    return limit.select(F.col("start").alias("x"), F.col("node").alias("y"), (F.col("p") / (F.col("p") + F.col("d") / F.col("all"))).alias("value"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each is connected with. Labels fall along edges and then along labels, halving distances, until nothing changes; state is checkpointed each round."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    state = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct().checkpoint()
    last = None
    while True:
        sym = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        state = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        mark = tuple(state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if mark == last:
            break
        last = mark
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def checkpoint_dir(spark) -> None:
    """The cluster's folder for checkpoints. A session on one machine alone may do without; it gets a folder that goes at exit."""
    import atexit
    import shutil
    import tempfile

    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lexispark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: each node takes the label of most weight around it, ties to the smaller. Deterministic; labels can swing between
    nodes for ever, so the result is by definition that of `rounds` rounds, or of fewer if nothing changes any more."""
    weight = "weight" if "weight" in edges.columns else None
    e = both_ways(edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w")))
    checkpoint_dir(edges.sparkSession)
    label = e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for i in range(rounds):
        votes = e.join(label, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        own = label.select(F.col("node").alias("src"), "community", F.lit(1e-6).alias("w"))  # a node stays where weights are equal
        total = votes.unionByName(own).groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = total.groupBy(F.col("src").alias("node")).agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("community"))
        new = best.checkpoint()
        if i and new.exceptAll(label).isEmpty():
            break
        label = new
    return label


def bridge_links(edges: DataFrame, clusters: DataFrame, b: float) -> DataFrame:
    """All links inside clusters; between each two clusters the strongest, as many as 2 b times a hundredth of their share of the largest such group."""
    c = clusters.select("node", "cluster")
    e = edges.join(c.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), "src").join(c.select(F.col("node").alias("dst"), F.col("cluster").alias("c2")), "dst")
    size = e.groupBy("c1", "c2").agg(F.count("*").alias("m"))
    most = size.agg(F.max("m").alias("most"))
    e = e.join(size, ["c1", "c2"]).crossJoin(F.broadcast(most))
    rank = F.row_number().over(Window.partitionBy("c1", "c2").orderBy(F.desc("weight"), "src", "dst"))
    room = round(b) * 2 * F.round(100 * F.col("m") / F.col("most"))
    return e.withColumn("rank", rank).where((F.col("c1") == F.col("c2")) | (F.col("rank") <= room)).select("src", "dst", "weight", "c1", "c2")


def bridge_by_confluence(edges: DataFrame, confluences: DataFrame, *, conditional: bool) -> DataFrame:
    """Links that have a confluence and a weight above 0.2 (conditional) or 0.02."""
    c = confluences.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return edges.join(c, ["src", "dst"], "left_semi").where(F.col("weight") > (0.2 if conditional else 0.02))


def maximal_cliques(edges: DataFrame) -> DataFrame:
    """(clique): maximal cliques as sorted arrays (Bron-Kerbosch with pivots), a task for each node.

    Nodes are ordered by degree; a clique is found at its first node, from that node's neighbours and the edges between them alone,
    so a large component is many tasks' work.
    """
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    deg = degrees(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rank = lambda n: deg.select(F.col("node").alias(n), F.col("degree").alias(f"d{n}"))
    placed = pairs.join(rank("a"), "a").join(rank("b"), "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    placed = placed.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))
    near = placed.select("u", "v", F.lit(True).alias("later")).unionByName(placed.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("later")))
    between = near.select("u", F.col("v").alias("a")).join(pairs, "a").join(near.select("u", F.col("v").alias("b")), ["u", "b"]).select("u", "a", "b", F.lit(None).cast("boolean").alias("later"))
    rows = near.select("u", F.col("v").alias("a"), F.col("v").alias("b"), "later").unionByName(between)
    kind = dict(pairs.dtypes)["a"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["later"].notna()], pdf[pdf["later"].isna()]
        later = set(own.loc[own["later"].astype(bool), "a"])
        found = cliques_of(list(zip(links["a"], links["b"])), later, set(own["a"]) - later)
        return pd.DataFrame([(sorted([key[0], *c]),) for c in found], columns=["clique"])

    return rows.groupBy("u").applyInPandas(run, f"clique array<{kind}>")


def cliques_of(pairs: list[tuple], candidates: set | None = None, before: set | None = None) -> list[set]:
    """Maximal cliques of the edges; of the candidates alone, and of those none that a node of `before` extends, if these are given."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out: list[set] = []
    stack = [(set(), set(near) if candidates is None else set(candidates), set(before or ()))]
    for v in stack[0][1] | stack[0][2]:
        near.setdefault(v, set())
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(r)
            continue
        if not p:
            continue
        pivot = max(p | x, key=lambda v: len(near[v] & p))
        for v in sorted(p - near[pivot]):
            stack.append((r | {v}, p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return out


#: Pairs for each item of the baskets up to which all their pairs are counted.
PAIRS = 8


def frequent_itemsets(baskets: DataFrame, items: str, least: int) -> DataFrame:
    """(items, freq): sets of items in at least so many baskets, without those a larger set of equal count holds.

    Items and pairs are counted by grouping; larger sets are found by FP-growth in the baskets that hold three frequent pairs or more,
    as no other basket can hold one. Where baskets are so large that they have more than PAIRS pairs an item, FP-growth runs on all of them.
    """
    from .occurrences import small

    checkpoint_dir(baskets.sparkSession)
    own = baskets.select(F.array_sort(F.array_compact(F.array_distinct(items))).alias("items"))
    each = own.select(F.explode("items").alias("item"), (F.size("items") - 1).cast("long").alias("others"))
    one = each.groupBy("item").agg(F.count("*").alias("freq"), F.sum("others").alias("others")).checkpoint()
    n, others = one.agg(F.sum("freq"), F.sum("others")).first()
    if n and others > 2 * PAIRS * n:
        sets = fp_growth(own, least)
    else:
        sets = one.where(F.col("freq") >= least).select(F.array("item").alias("items"), "freq")
        at = own.withColumn("_basket", F.monotonically_increasing_id()).select("_basket", "items", F.posexplode("items").alias("at", "x"))
        both = at.select("_basket", "x", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("y"))
        pairs = both.groupBy("x", "y").agg(F.count("*").alias("freq")).where(F.col("freq") >= least).checkpoint()
        if not pairs.isEmpty():
            kept = both.join(F.broadcast(pairs) if small(pairs) else pairs, ["x", "y"], "left_semi").groupBy("_basket").agg(F.collect_list(F.array("x", "y")).alias("p"))
            larger = kept.where(F.size("p") > 2).select(F.array_distinct(F.flatten("p")).alias("items")).checkpoint()
            sets = sets.unionByName(pairs.select(F.array("x", "y").alias("items"), "freq"))
            sets = sets if larger.isEmpty() else sets.unionByName(fp_growth(larger, least).where(F.size("items") > 2))
    # a set is closed unless one item more leaves its count as it is
    larger = sets.where(F.size("items") > 1).select(F.col("freq"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items")).distinct()
    return sets.join(larger, ["items", "freq"], "left_anti")


def fp_growth(baskets: DataFrame, least: int) -> DataFrame:
    """(items, freq): all sets of items in at least so many baskets (items, distinct), by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    n = max(1, baskets.count())
    sets = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n)).fit(baskets).freqItemsets
    return sets.select(F.array_sort("items").alias("items"), "freq").where(F.col("freq") >= least)
