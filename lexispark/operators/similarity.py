"""Similarities of terms from their co-occurrence counts, kept as coordinate tables (x, y, n); missing cells are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diagonal(cooc: DataFrame) -> DataFrame:
    return cooc.where("x = y").select(F.col("x").alias("t"), F.col("n").alias("nt"))


def mirrored(cooc: DataFrame) -> DataFrame:
    """Off-diagonal cells in both orders, from cells stored once."""
    off = cooc.where("x <> y")
    return off.select("x", "y", "n").unionByName(off.select(F.col("y").alias("x"), F.col("x").alias("y"), "n"))


def tficf(local_count: Column, local_total: Column, global_count: Column, global_total: Column) -> Column:
    """(local total / local count) ln(global total / global count); impossible counts are an error."""
    possible = (local_total >= local_count) & (global_total >= global_count) & (local_total <= global_total)
    return F.when(possible, local_total / local_count * F.log(global_total / global_count)).otherwise(F.raise_error(F.lit("frequency impossible")).cast("double"))


def tficf_table(local: DataFrame, whole: DataFrame, local_total: int, *, global_total: int | None = None, least: int = 1) -> DataFrame:
    """Scores of the terms (term, n_docs) that more than `least` local documents hold. The global total is the local one unless given; a term is then counted in no more documents than that."""
    g = whole.select("term", F.col("n_docs").alias("g_docs"))
    total = global_total if global_total is not None else local_total
    joined = local.where(F.col("n_docs") > least).join(g, "term")
    return joined.select("term", tficf(F.col("n_docs"), F.lit(local_total), F.least(F.col("g_docs"), F.lit(total)), F.lit(total)).alias("score"))


def conditional(cooc: DataFrame) -> DataFrame:
    """(x, y, value): the larger of P(x given y) and P(y given x), in the direction it holds; ties keep the smaller term first."""
    d = diagonal(cooc)
    off = cooc.where("x <> y").select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a"), "n")
    p = off.join(d.select(F.col("t").alias("a"), F.col("nt").alias("na")), "a").join(d.select(F.col("t").alias("b"), F.col("nt").alias("nb")), "b")
    ij, ji = F.col("n") / F.col("nb"), F.col("n") / F.col("na")
    return p.select(F.when(ij >= ji, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(ij >= ji, F.col("b")).otherwise(F.col("a")).alias("y"), F.greatest(ij, ji).alias("value"))


def conditional_matrix(cooc: DataFrame) -> DataFrame:
    """(x, y, value): cells over their column's sum, kept where at least the smallest of the rows' maxima."""
    p = mirrored(cooc).withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("y")))
    least = p.groupBy("x").agg(F.max("value").alias("m")).agg(F.min("m").alias("_least"))
    return p.join(F.broadcast(least), F.col("value") >= F.col("_least")).select("x", "y", "value")


def mutual_information(cooc: DataFrame) -> DataFrame:
    """(x, y, mi): ln(N n_xy / (s_x s_y)) of off-diagonal cells; s are the sums of rows, N their sum."""
    m = mirrored(cooc)
    s = m.groupBy("x").agg(F.sum("n").alias("s"))
    total = s.agg(F.sum("s").alias("whole"))
    return (
        m.join(s, "x")
        .join(s.select(F.col("x").alias("y"), F.col("s").alias("sy")), "y")
        .crossJoin(F.broadcast(total))
        .select("x", "y", F.log(F.col("whole") * F.col("n") / (F.col("s") * F.col("sy"))).alias("mi"))
    )


def log_distributional(cooc: DataFrame, *, keep_all: bool = False) -> DataFrame:
    """(x, y, value): sum over k other than x, y of min(mi_xk, mi_yk), over the same sum of mi_xk; cells above the greatest of the rows' minima.

    Missing cells are 0 and count in the minima, also against negative values. The sum over all k is split into
    what the common neighbours of x and y add, found by a join on k over existing cells, and each term's own sum
    of negative values, so no cube of terms is formed.
    """
    mi = mutual_information(cooc)
    low = F.least(F.col("mi"), F.lit(0.0))
    own = mi.groupBy("x").agg(F.sum("mi").alias("total"), F.sum(low).alias("negative"))
    a = mi.select("x", F.col("y").alias("k"), F.col("mi").alias("a"))
    b = mi.select(F.col("x").alias("y"), F.col("y").alias("k"), F.col("mi").alias("b"))
    gain = F.least("a", "b") - F.least(F.col("a"), F.lit(0.0)) - F.least(F.col("b"), F.lit(0.0))
    common = a.join(b, "k").where("x <> y").groupBy("x", "y").agg(F.sum(gain).alias("common"))
    pairs = own.crossJoin(own.select(F.col("x").alias("y"), F.col("negative").alias("negative_y"))).where("x <> y")  # terms of the list, both ways: the result's own size
    cell = mi.select("x", "y", "mi")
    joined = pairs.join(common, ["x", "y"], "left").join(cell, ["x", "y"], "left")
    here = F.coalesce("mi", F.lit(0.0))
    top = F.coalesce("common", F.lit(0.0)) + F.col("negative") + F.col("negative_y") - 2 * F.least(here, F.lit(0.0))
    value = F.coalesce(F.try_divide(top, F.col("total") - here), F.lit(0.0))
    out = joined.select("x", "y", value.alias("value"))
    if keep_all:
        return out
    # the diagonal's zeros are cells of their rows too
    floor = out.groupBy("x").agg(F.least(F.min("value"), F.lit(0.0)).alias("m")).agg(F.max("m").alias("_floor"))
    return out.join(F.broadcast(floor), F.col("value") > F.col("_floor")).select("x", "y", "value")


def _overlap(mi: DataFrame) -> DataFrame:
    """(x, y, top, mi) of cells (x, y, mi) above 0 off the diagonal: the sums over k of the smaller of mi_xk and mi_yk, found by a join on k."""
    a, b = mi.select("x", F.col("y").alias("k"), F.col("mi").alias("a")), mi.select(F.col("x").alias("y"), F.col("y").alias("k"), F.col("mi").alias("b"))
    top = a.join(b, "k").where("x <> y").groupBy("x", "y").agg(F.sum(F.least("a", "b")).alias("top"))
    return top.join(mi, ["x", "y"], "left").select("x", "y", "top", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def distributional(cooc: DataFrame) -> DataFrame:
    """(x, y, value): with mi_xy = n_xy^2 / (n_xx n_yy), the sum over k other than x, y of the smaller of mi_xk and mi_yk over that of mi_xk; 1 on the diagonal. Cells of 0 are left out."""
    d = diagonal(cooc)
    m = mirrored(cooc).join(d.select(F.col("t").alias("x"), F.col("nt").alias("nx")), "x").join(d.select(F.col("t").alias("y"), F.col("nt").alias("ny")), "y")
    mi = m.select("x", "y", (F.col("n") / F.col("nx") * (F.col("n") / F.col("ny"))).alias("mi"))
    total = mi.groupBy("x").agg(F.sum("mi").alias("total"))
    off = _overlap(mi).join(total, "x").select("x", "y", F.coalesce(F.try_divide(F.col("top"), F.col("total") - F.col("mi")), F.lit(0.0)).alias("value")).where("value > 0")
    return off.unionByName(total.where("total > 0").select("x", F.col("x").alias("y"), F.lit(1.0).alias("value")))


def distributional_links(cooc: DataFrame) -> DataFrame:
    """(x, y, value): the ratio of sums of the smaller positive mutual informations, where it is above the smallest of the columns' maxima and the larger of both directions."""
    mi = mutual_information(cooc).where("mi > 0")
    total = mi.groupBy("x").agg(F.sum("mi").alias("total"))
    r = _overlap(mi).join(total, "x").select("x", "y", F.round(F.coalesce(F.try_divide(F.col("top"), F.col("total") - F.col("mi")), F.lit(0.0)), 12).alias("value"))
    terms = diagonal(cooc).select(F.col("t").alias("y"))
    floor = terms.join(r.groupBy("y").agg(F.max("value").alias("m")), "y", "left").agg(F.min(F.coalesce("m", F.lit(0.0))).alias("_floor"))
    other = r.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("value").alias("back"))
    kept = r.join(F.broadcast(floor), F.col("value") > F.col("_floor")).join(other, ["x", "y"], "left")
    return kept.where(F.col("value") > F.coalesce("back", F.lit(0.0))).select("x", "y", "value")


def inclusion_specificity(cooc: DataFrame, terms: int | None = None, *, mode: str = "documented") -> DataFrame:
    """(term, inclusion, specificity) from cells stored once (x >= y).

    With g and s the sums over other terms of P(i given j) and P(j given i) over n - 1: documented mode gives g + s and g - s, code mode 2 g and 2 s.
    """
    p = cooc.join(diagonal(cooc), F.col("y") == F.col("t")).select("x", "y", (F.col("n") / F.col("nt")).alias("p"))
    g = p.groupBy(F.col("x").alias("term")).agg(F.sum("p").alias("v"))
    s = p.groupBy(F.col("y").alias("term")).agg(F.sum("p").alias("h"))
    both = g.join(s, "term", "full").select("term", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("h", F.lit(0.0)).alias("h"))
    n = F.lit(terms) if terms is not None else F.count("*").over(Window.partitionBy())
    v, h = (F.col("v") - 1) / (n - 1), (F.col("h") - 1) / (n - 1)
    return both.select("term", *((2 * v).alias("inclusion"), (2 * h).alias("specificity")) if mode == "code" else ((v + h).alias("inclusion"), (v - h).alias("specificity")))


def normalise_global(df: DataFrame, value: str) -> DataFrame:
    """(value - least) over the greatest value."""
    edge = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.crossJoin(F.broadcast(edge)).withColumn(value, F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high")), F.lit(0.0))).drop("_low", "_high")


def normalise_local(value: str, k: int = 5) -> Column:
    """1 + ln(10^k x), 0 where x isn't above 0."""
    x = F.col(value)
    return F.when(x > 0, 1 + F.log(F.pow(F.lit(10.0), F.lit(k)) * x)).otherwise(0.0)


def maxmini(cells: DataFrame) -> DataFrame:
    """Cells above the greatest of the rows' minima; the rest are 0, that is, absent."""
    floor = cells.groupBy("x").agg(F.min("value").alias("m")).agg(F.max("m").alias("_floor"))
    return cells.join(F.broadcast(floor), F.col("value") > F.col("_floor")).select("x", "y", "value")


def symmetrised(cells: DataFrame) -> DataFrame:
    """Of (x, y) and (y, x) the cell of larger value; ties keep the one with x before y."""
    key = cells.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", "y", "value")
    best = key.groupBy("a", "b").agg(F.max(F.struct("value", (F.col("x") < F.col("y")).alias("first"), "x", "y")).alias("m"))
    return best.select("m.x", "m.y", "m.value")


def link_budget(cells: DataFrame, terms: int, *, order: int = 1, strongest: bool = True) -> DataFrame:
    """The budget of links for so many terms: 10 n (ln n)^2 (order 1) or n (ln n)^2 (order 2), strongest or weakest first."""
    import math

    n = max(terms, 1)
    budget = round((10 if order == 1 else 1) * n * math.log(n) ** 2)
    return cells.orderBy(F.desc("value") if strongest else F.asc("value"), "x", "y").limit(budget)


def nearest_links(cells: DataFrame, k: int) -> DataFrame:
    """The k strongest positive links that leave each term."""
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("value"), "y"))
    return cells.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= k)


SIMILARITIES = {"Conditional": conditional_matrix, "Distributional": log_distributional, "DistributionalSquare": distributional, "DistributionalLinks": distributional_links}


def similarity_links(cooc: DataFrame, *, measure: str = "Conditional", threshold: float = 0.0, strongest: bool = True) -> DataFrame:
    """Co-occurrence to links: similarity, threshold, symmetry, budget."""
    from .occurrences import small

    off = cooc.where("x <> y")
    names = off.select(F.col("x").alias("t")).union(off.select("y")).distinct()
    if not small(names, 20_000):
        raise ValueError("similarities are made over a term list; it has more than 20,000 terms")
    cells = SIMILARITIES[measure](cooc).where(F.col("value") > threshold)
    cells = symmetrised(cells) if measure == "Distributional" else cells
    return link_budget(cells, names.count(), order=1 if measure == "Conditional" else 2, strongest=strongest)
