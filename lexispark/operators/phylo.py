"""Temporal term graphs: periods, groups of terms per period, links between periods, branches, quality, merging, labels.

Groups are rows (period, idx, terms, weight); links are rows between group ids. All steps are joins and
aggregates; the only loop is over similarity thresholds, whose number is bounded.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def periods(first: int, last: int, length: int, step: int) -> list[tuple[int, int]]:
    """Hopping periods of `length` dates that begin every `step`; one that would pass the end is dropped."""
    return [(s, s + length - 1) for s in range(first, last - length + 2, step)]


def into_periods(docs: DataFrame, first: int, last: int, length: int, step: int, *, consuming: bool = False) -> DataFrame:
    """docs (date) with the bounds of each period they fall in, or of the first only. Each row names its own periods, so nothing is joined."""
    n = len(periods(first, last, length, step))
    d = F.col("date") - first
    low = F.greatest(F.lit(0), F.ceil((d - (length - 1)) / step)).cast("int")
    high = F.least(F.lit(n - 1), F.floor(d / step)).cast("int")
    k = F.array(low) if consuming else F.sequence(low, high)
    inside = docs.where((F.col("date") >= first) & (F.col("date") <= last)).where(low <= high)
    return inside.select("*", F.explode(k).alias("_k")).select(*docs.columns, (first + F.col("_k") * step).cast("int").alias("first"), (first + F.col("_k") * step + length - 1).cast("int").alias("last"))


def clusters_of_periods(docs: DataFrame, *, support: int = 2, size: int = 2, kind: str = "itemsets", threshold: int = 1) -> DataFrame:
    """(first, last, terms, support): closed sets of terms of each period's documents (first, last, terms), or maximal cliques of their co-occurrences.

    Term sets of documents are restricted to a map list, so a period's distinct sets are few; equal sets are counted before a period is gathered.
    """
    counted = docs.select("first", "last", F.array_sort(F.array_distinct("terms")).alias("terms")).where(F.size("terms") > 0).groupBy("first", "last", "terms").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["first"].iloc[0], pdf["last"].iloc[0]
        baskets = [(frozenset(t), n) for t, n in zip(pdf["terms"], pdf["n"])]
        if kind == "itemsets":
            found = closed_sets(baskets, support)
        else:
            pairs: dict[tuple, int] = {}
            for t, n in baskets:
                ts = sorted(t)
                for i, x in enumerate(ts):
                    for y in ts[i + 1 :]:
                        pairs[x, y] = pairs.get((x, y), 0) + n
            found = {frozenset(c): sum(n for t, n in baskets if c <= t) for c in graph.cliques_of([p for p, n in pairs.items() if n > threshold])}
        return pd.DataFrame([(a, b, sorted(s), n) for s, n in found.items() if len(s) >= size], columns=["first", "last", "terms", "support"])

    return counted.groupBy("first", "last").applyInPandas(run, "first int, last int, terms array<string>, support long")


def closed_sets(baskets: list[tuple[frozenset, int]], support: int) -> dict[frozenset, int]:
    """Closed sets of items with their support: sets that are the intersection of all baskets that hold them."""
    items = sorted({i for b, _ in baskets for i in b})
    out: dict[frozenset, int] = {}

    def grow(rows: list[tuple[frozenset, int]], start: int, closure: frozenset) -> None:
        for k in range(start, len(items)):
            x = items[k]
            if x in closure:
                continue
            own = [r for r in rows if x in r[0]]
            n = sum(c for _, c in own)
            if n < support:
                continue
            closed = frozenset.intersection(*(b for b, _ in own))
            if any(items[j] in closed and items[j] not in closure for j in range(k)):
                continue  # the same set comes from an earlier item
            out[closed] = n
            grow(own, k + 1, closed)

    if baskets:
        whole = sum(n for _, n in baskets)
        root = frozenset.intersection(*(b for b, _ in baskets))
        if root and whole >= support:
            out[root] = whole
        grow(baskets, 0, root)
    return out


def filter_clusters(clusters: DataFrame, threshold: int, by: str = "support", *, keep_filled: bool = True) -> DataFrame:
    """Clusters of at least the threshold; with keep_filled a period without any lowers it to its greatest."""
    top = F.max(by).over(Window.partitionBy("first", "last"))
    limit = F.least(F.lit(threshold), top) if keep_filled else F.lit(threshold)
    return clusters.withColumn("_limit", limit).where(F.col(by) >= F.col("_limit")).drop("_limit")


def without_nested(clusters: DataFrame) -> DataFrame:
    """Clusters that no other of their period holds. Candidates share the rarest term of the smaller one, not just the period."""
    c = clusters.withColumn("_id", F.monotonically_increasing_id())
    each = c.select("_id", "first", "last", "terms", F.explode("terms").alias("t"))
    df = each.groupBy("first", "last", "t").agg(F.count("*").alias("n"))
    rarest = each.join(df, ["first", "last", "t"]).groupBy("_id", "first", "last", "terms").agg(F.min(F.struct("n", "t")).alias("r")).select("_id", "first", "last", "terms", F.col("r.t").alias("t"))
    other = each.select(F.col("_id").alias("_o"), "first", "last", F.col("terms").alias("more"), "t")
    nested = rarest.join(other, ["first", "last", "t"]).where((F.size("more") > F.size("terms")) & (F.size(F.array_except("terms", "more")) == 0)).select("_id").distinct()
    return c.join(nested, "_id", "left_anti").drop("_id")


def groups(clusters: DataFrame, scale: int = 1) -> DataFrame:
    """Groups with ids (first, scale, idx): numbered within a period by their terms."""
    idx = F.row_number().over(Window.partitionBy("first").orderBy("terms")) - 1
    out = clusters.withColumn("idx", idx).withColumn("scale", F.lit(scale))
    return out.select(F.concat_ws("-", "first", "scale", "idx").alias("id"), "first", "last", "scale", "idx", "terms", F.col("support").alias("weight"))


def inverse_log(n: Column, documents: Column, sense: Column | float) -> Column:
    """What a term of n documents weighs: 1 / (log(n + 1/tan) / log(N + 1/tan)) with the sense of the weighting as an angle."""
    k = 1 / math.tan(sense * math.pi / 2)
    return F.log(documents + k) / F.log(n + k)


def weighted_jaccard(a: str, b: str, weights: str) -> Column:
    """Weight of shared terms over weight of all terms of two arrays; weights: a map column. Without shared terms 0, for equal sets 1."""
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.element_at(F.col(weights), t), F.lit(0.0)))
    shared, union = F.array_intersect(a, b), F.array_union(a, b)
    return F.when(F.size(shared) == 0, 0.0).when(F.size(shared) == F.size(union), 1.0).otherwise(total(shared) / total(union))


def pair_similarity(pairs: DataFrame, term_counts: DataFrame, documents: int, sense: float = 0.5) -> DataFrame:
    """pairs (a, b arrays of terms) with `similarity`: the weighted log-Jaccard, plain Jaccard for sense 0.

    Term weights are joined to the terms of each pair, so no map of all terms is sent around.
    """
    p = pairs.withColumn("_p", F.xxhash64("a", "b"))  # equal pairs have one similarity: their sums grow alike
    if sense == 0:
        shared, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
        return p.withColumn("similarity", shared / union).drop("_p")
    weight = inverse_log(F.col("n_docs"), F.lit(documents), sense)
    w = term_counts.select("term", (weight if sense > 0 else F.log(F.col("n_docs") + 1 / math.tan(-sense * math.pi / 2))).alias("w"))
    each = p.select("_p", F.explode(F.array_union("a", "b")).alias("term"), F.array_intersect("a", "b").alias("both"))
    sums = each.join(w, "term").groupBy("_p").agg(F.sum(F.when(F.array_contains("both", F.col("term")), F.col("w")).otherwise(0.0)).alias("shared"), F.sum("w").alias("all"))
    value = F.when(F.size(F.array_intersect("a", "b")) == 0, 0.0).when(F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a")) == 0, 1.0).otherwise(F.col("shared") / F.col("all"))
    return p.join(sums, "_p", "left").withColumn("similarity", F.coalesce(value, F.lit(0.0))).drop("_p", "shared", "all")


def candidate_links(group: DataFrame, frame: int, step: int = 1, *, least_shared: int = 1) -> DataFrame:
    """(src, dst, gap): pairs of groups of different periods within a frame that share terms, found by an equi-join on terms."""
    each = group.select("id", "first", F.explode("terms").alias("term"))
    later = each.select(F.col("id").alias("dst"), F.col("first").alias("f2"), "term")
    pairs = each.join(later, "term").where((F.col("f2") > F.col("first")) & (F.col("f2") <= F.col("first") + frame * step))
    return pairs.groupBy(F.col("id").alias("src"), "dst", (F.col("f2") - F.col("first")).alias("gap")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)


def temporal_links(group: DataFrame, term_counts: DataFrame, documents: int, *, frame: int = 5, step: int = 1, sense: float = 0.5, threshold: float = 0.1) -> DataFrame:
    """(src, dst, similarity): each group's best matches in the nearest period that has any above the threshold, forwards and backwards."""
    g = group.select("id", "terms")
    pairs = candidate_links(group, frame, step).drop("shared").join(g.select(F.col("id").alias("src"), F.col("terms").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("terms").alias("b")), "dst")
    scored = pair_similarity(pairs, term_counts, documents, sense).where(F.col("similarity") >= threshold).select("src", "dst", "gap", F.round("similarity", 9).alias("similarity"))
    ahead = Window.partitionBy("src").orderBy("gap", F.desc("similarity"))
    back = Window.partitionBy("dst").orderBy("gap", F.desc("similarity"))
    ranked = scored.withColumn("r1", F.rank().over(ahead)).withColumn("r2", F.rank().over(back))
    return ranked.where("r1 = 1 OR r2 = 1").select("src", "dst", "similarity")


def branches(group: DataFrame, links: DataFrame) -> DataFrame:
    """groups with their branch: connected components of the links, groups without links alone."""
    c = graph.components(links.select("src", "dst"))
    return group.join(c.withColumnRenamed("component", "branch"), F.col("id") == F.col("node"), "left").withColumn("branch", F.coalesce("branch", "id")).drop("node")


def quality(group: DataFrame, level: float, roots: int) -> float:
    """The quality of a partition into branches at a level in 0..1: over terms, the branches' F-scores by their sizes.

    group: id, first, branch, terms. Recall is a branch's share of the groups with a term, accuracy the share of
    its groups, in periods where the term is, that have it.
    """
    each = group.select("id", "first", "branch", F.explode("terms").alias("term"))
    in_branch = each.groupBy("term", "branch").agg(F.countDistinct("id").alias("hits"))
    whole = each.groupBy("term").agg(F.countDistinct("id").alias("all"))
    size = group.groupBy("branch").agg(F.count("*").alias("size"))
    spans = each.select("term", "first").distinct()
    by_period = group.groupBy("branch", "first").agg(F.count("*").alias("m"))
    seen = in_branch.select("term", "branch").join(spans, "term").join(by_period, ["branch", "first"]).groupBy("term", "branch").agg(F.sum("m").alias("seen"))
    t = in_branch.join(whole, "term").join(size, "branch").join(seen, ["term", "branch"])
    beta = math.tan(level * math.pi / 2)
    accuracy, recall = F.col("hits") / F.col("seen"), F.col("hits") / F.col("all")
    score = (1 + beta**2) * accuracy * recall / (beta**2 * accuracy + recall)
    weighted = t.withColumn("f", score).withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy("term")))
    return float(weighted.agg(F.sum(F.col("share") * F.col("f"))).first()[0] or 0.0) / max(1, roots)


def ladder(start: float, step: float) -> list[float]:
    """Thresholds start, start + step ... up to 1."""
    out, x = [], start
    while x <= 1 + 1e-12:
        out.append(round(x, 12))
        x += step
    return out


def sea_level_rise(group: DataFrame, term_counts: DataFrame, documents: int, *, level: float = 0.5, thresholds: list[float] | None = None, frame: int = 5, step: int = 1, min_branch: int = 3) -> tuple[DataFrame, float]:
    """Raises the threshold of links while quality doesn't fall and some branch stays long enough: (groups with branches, the threshold kept)."""
    thresholds = thresholds or ladder(0.1, 0.2)
    graph.checkpoint_dir(group.sparkSession)
    group = group.checkpoint()  # read by every step of the ladder, as are the links
    roots = group.select(F.explode("terms")).distinct().count()
    links = temporal_links(group, term_counts, documents, frame=frame, step=step, threshold=thresholds[0]).checkpoint()
    best, kept = branches(group, links), thresholds[0]
    score = quality(best, level, roots)
    for t in thresholds[1:]:
        new = branches(group, links.where(F.col("similarity") >= t)).checkpoint()
        q = quality(new, level, roots)
        if q < score or new.groupBy("branch").agg(F.countDistinct("first").alias("n")).where(F.col("n") >= min_branch).isEmpty():
            break
        best, kept, score = new, t, q
    return best, kept


def synchronic_merge(group: DataFrame, term_counts: DataFrame, documents: int, *, threshold: float = 0.5, sense: float = 0.5) -> DataFrame:
    """The next scale: groups of one period and branch that are similar enough, and those linked through them, become one."""
    each = group.select("id", "first", "branch", F.explode("terms").alias("term"))
    other = each.select(F.col("id").alias("dst"), "first", "branch", "term")
    pairs = each.join(other, ["first", "branch", "term"]).where(F.col("id") < F.col("dst")).select(F.col("id").alias("src"), "dst").distinct()
    g = group.select("id", "terms")
    pairs = pairs.join(g.select(F.col("id").alias("src"), F.col("terms").alias("a")), "src").join(g.select(F.col("id").alias("dst"), F.col("terms").alias("b")), "dst")
    edges = pair_similarity(pairs, term_counts, documents, sense).where(F.col("similarity") >= threshold).select("src", "dst")
    part = graph.components(edges)
    named = group.join(part, F.col("id") == F.col("node"), "left").withColumn("parent", F.coalesce("component", "id"))
    return named.groupBy("first", "last", "branch", (F.col("scale") + 1).alias("scale"), "parent").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"), F.sum("weight").alias("weight"), F.array_sort(F.collect_list("id")).alias("children")).withColumnRenamed("parent", "id")


def term_dynamics(group: DataFrame) -> DataFrame:
    """(id, term, dynamic): 0 emerging (first and last here), 1 emergence (first here), 2 decrease (last here), 3 regular."""
    each = group.select("id", "first", F.explode("terms").alias("term"))
    w = Window.partitionBy("term")
    low, high = F.min("first").over(w), F.max("first").over(w)
    kind = F.when((F.col("first") == low) & (F.col("first") == high), 0).when(F.col("first") == low, 1).when(F.col("first") == high, 2).otherwise(3)
    return each.select("id", "term", kind.alias("dynamic"))


def branch_dates(group: DataFrame) -> DataFrame:
    return group.groupBy("branch").agg(F.min("first").alias("birth"), (F.max("last") - F.min("first")).alias("age"), F.countDistinct("first").alias("size"), F.count("*").alias("n_groups"))


def large_branches(group: DataFrame, least: int) -> DataFrame:
    kept = group.groupBy("branch").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return group.join(kept.select("branch"), "branch", "left_semi")


def branch_labels(group: DataFrame, n: int = 3) -> DataFrame:
    """(branch, label): the n terms of most tf ln(G / df) in each branch; ties by term."""
    each = group.select("branch", "id", F.explode("terms").alias("term"))
    total = group.agg(F.countDistinct("branch").alias("total"))
    tf = each.groupBy("branch", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("s", F.round(F.col("tf") * F.log(F.col("total") / F.col("df") + 1), 9))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("s"), "term"))).where(F.col("r") <= n)
    return ranked.groupBy("branch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("label"))


def merged_pointers(links: DataFrame) -> DataFrame:
    """Links found in both directions as one, with the greater weight."""
    return links.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("similarity").alias("similarity"))


def adaptive_ladder(similarities: list[float], steps: int) -> list[float]:
    """Thresholds at even places among the sorted distinct similarities, squared: driver work on a bounded list of rounded values."""
    xs = sorted(set(similarities))
    if not xs:
        return []
    return [xs[min(len(xs) - 1, int(len(xs) * k / steps))] ** 2 for k in range(steps)]


def evolving_ladder(scores: list[tuple[float, float]]) -> list[float]:
    """Thresholds at which quality has a local maximum: (threshold, quality) in order."""
    return [scores[i][0] for i in range(1, len(scores) - 1) if scores[i - 1][1] < scores[i][1] > scores[i + 1][1]]


def weighted_similarity(pairs: DataFrame, term_counts: DataFrame, documents: int, sense: float = 0.5) -> DataFrame:
    """pairs (a, b) with `similarity`: the weight of shared terms over that of the lighter of both."""
    p = pairs.withColumn("_p", F.xxhash64("a", "b"))  # equal pairs have one similarity: their sums grow alike
    w = term_counts.select("term", inverse_log(F.col("n_docs"), F.lit(documents), sense).alias("w"))
    each = p.select("_p", "a", "b", F.explode(F.array_union("a", "b")).alias("term")).join(w, "term")
    inside = lambda c: F.when(F.array_contains(c, F.col("term")), F.col("w")).otherwise(0.0)
    both = F.when(F.array_contains("a", F.col("term")) & F.array_contains("b", F.col("term")), F.col("w")).otherwise(0.0)
    s = each.groupBy("_p").agg(F.sum(both).alias("shared_w"), F.sum(inside("a")).alias("aw"), F.sum(inside("b")).alias("bw"))
    return p.join(s, "_p", "left").withColumn("similarity", F.coalesce(F.try_divide(F.col("shared_w"), F.least("aw", "bw")), F.lit(0.0))).drop("_p", "shared_w", "aw", "bw")


def confidence(cooc: DataFrame) -> DataFrame:
    """(x, y, value): the larger of n_xy / n_x and n_xy / n_y."""
    d = cooc.where("x = y").select(F.col("x").alias("t"), F.col("n").alias("nt"))
    off = cooc.where("x <> y")
    both = off.join(d.withColumnRenamed("t", "x").withColumnRenamed("nt", "nx"), "x").join(d.withColumnRenamed("t", "y").withColumnRenamed("nt", "ny"), "y")
    return both.select("x", "y", F.greatest(F.col("n") / F.col("nx"), F.col("n") / F.col("ny")).alias("value"))


def ancestors(group: DataFrame, links: DataFrame, term_counts: DataFrame, documents: int, *, threshold: float = 0.1) -> DataFrame:
    """(head, other, similarity): for groups without a parent the groups of earlier periods in other branches that are most alike."""
    heads = group.join(links.select(F.col("dst").alias("id")), "id", "left_anti")
    each = heads.select(F.col("id").alias("head"), "branch", "first", F.col("terms").alias("a"), F.explode("terms").alias("term"))
    old = group.select(F.col("id").alias("other"), F.col("branch").alias("b2"), F.col("first").alias("f2"), F.col("terms").alias("b"), F.explode("terms").alias("term"))
    pairs = each.join(old, "term").where("branch <> b2 AND f2 < first").select("head", "other", "a", "b").distinct()
    scored = pair_similarity(pairs, term_counts, documents).where(F.col("similarity") >= threshold)
    r = F.row_number().over(Window.partitionBy("head").orderBy(F.desc(F.round("similarity", 9)), "other"))
    return scored.withColumn("_r", r).where("_r = 1").select("head", "other", "similarity")


def diamonds(links: DataFrame) -> DataFrame:
    """(parent, child, between): pairs of groups with two groups or more between them."""
    down = links.select(F.col("src").alias("parent"), F.col("dst").alias("mid"))
    up = links.select(F.col("src").alias("mid"), F.col("dst").alias("child"))
    return down.join(up, "mid").groupBy("parent", "child").agg(F.array_sort(F.collect_set("mid")).alias("between")).where(F.size("between") > 1)


def diamond_counts(down: DataFrame, up: DataFrame) -> DataFrame:
    """(parent, child, n) with n > 1: groups between two others, counted. down: parent, mid; up: mid, child (numbers or strings); rows may repeat.

    Groups with the same children are one class. A parent's groups are counted by class, and children are set beside these counts,
    not beside each group. One shuffle of `down` deals it by parent; tables of classes are sent around only if they are few.
    """
    from .graph import checkpoint_dir
    from .occurrences import small

    checkpoint_dir(up.sparkSession)
    hint = lambda df: F.broadcast(df) if small(df) else df
    sets = up.where("mid IS NOT NULL").select("mid", "child").distinct().groupBy("mid").agg(F.sort_array(F.collect_list(F.struct("child"))).alias("children"))
    sets = sets.withColumn("same", F.sha2(F.to_json("children"), 256)).checkpoint()
    classes = sets.groupBy("same").agg(F.min("mid").alias("class"), F.first("children").alias("children")).checkpoint()
    own = sets.select("mid", "same").join(hint(classes.select("same", "class")), "same").select("mid", "class")
    n = down.select("parent", "mid").join(hint(own), "mid").repartition("parent").groupBy("parent", "class").agg(F.countDistinct("mid").alias("n"))
    pairs = n.join(hint(classes.select("class", "children")), "class").select("parent", F.explode("children").alias("c"), "n").select("parent", "c.child", "n")
    return pairs.groupBy("parent", "child").agg(F.sum("n").alias("n")).where("n > 1")


def term_scores(group: DataFrame, cooc: DataFrame) -> DataFrame:
    """(id, term, genericity, specificity, inclusion) of terms within their group: conditional sums over its other terms, over their number + 1."""
    each = group.select("id", F.explode("terms").alias("x"), "terms")
    pairs = each.select("id", "x", F.size("terms").alias("k"), F.explode("terms").alias("y")).where("x <> y")
    sym = cooc.where("x <> y").select("x", "y", "n").unionByName(cooc.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))
    d = cooc.where("x = y").select(F.col("x").alias("t"), F.col("n").alias("nt"))
    p = pairs.join(sym, ["x", "y"], "left").join(d.select(F.col("t").alias("x"), F.col("nt").alias("nx")), "x").join(d.select(F.col("t").alias("y"), F.col("nt").alias("ny")), "y")
    n = F.coalesce("n", F.lit(0))
    s = p.groupBy("id", F.col("x").alias("term"), "k").agg(F.sum(n / F.col("ny")).alias("g"), F.sum(n / F.col("nx")).alias("s"))
    over = F.col("k") + 1
    return s.select("id", "term", (F.col("g") / over).alias("genericity"), (F.col("s") / over).alias("specificity"), ((F.col("g") + F.col("s")) / over).alias("inclusion"))


def inclusive_labels(group: DataFrame, cooc: DataFrame, n: int = 2, *, emergent: bool = False) -> DataFrame:
    """(id, label): the n terms of greatest inclusion in each group; with emergent, new terms first among equals."""
    s = term_scores(group, cooc).withColumn("inclusion", F.round("inclusion", 9))
    s = s.join(term_dynamics(group), ["id", "term"])
    order = [F.desc("inclusion"), F.asc("dynamic"), "term"] if emergent else [F.desc("inclusion"), "term"]
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("r") <= n)
    return r.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("label"))


def weighted_itemsets(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """sets (items) with the weight and sources of all documents (terms, weight, sources) that hold them; candidates share a set's rarest term."""
    s = sets.select("items").distinct()
    each = docs.withColumn("_d", F.monotonically_increasing_id()).select("_d", "terms", "weight", "sources", F.explode("terms").alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("n"))
    key = s.select("items", F.explode("items").alias("t")).join(df, "t").groupBy("items").agg(F.min(F.struct("n", "t")).alias("m")).select("items", F.col("m.t").alias("t"))
    hit = key.join(each, "t").where(F.size(F.array_except("items", "terms")) == 0)
    return hit.groupBy("items").agg(F.count("*").alias("support"), F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def default_level(edges: int, nodes: int) -> float:
    """A level of granularity from the mean degree of the seabed's links: dense graphs are cut finer. Bounds are parameters of this engine."""
    degree = 2 * edges / max(1, nodes)
    return 0.1 if degree < 1 else 0.3 if degree < 2 else 0.5 if degree < 4 else 0.7
