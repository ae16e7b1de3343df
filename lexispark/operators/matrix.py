"""A kit for sparse matrices as coordinate tables (i, j, v): missing cells are 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def off_diagonal(m: DataFrame) -> DataFrame:
    return m.where("i <> j")


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def elementwise(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of both matrices' cells; a cell that neither has stays 0, so f(0, 0) must be 0."""
    left, right = a.select("i", "j", F.col("v").alias("a")), b.select("i", "j", F.col("v").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return left.join(right, ["i", "j"], "full").select("i", "j", f(zero("a"), zero("b")).alias("v")).where("v <> 0")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: an equi-join on the inner index and a sum with partial aggregation."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return a.join(right, F.col("j") == F.col("k")).groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row_sums(m: DataFrame, *, diagonal: bool = True) -> DataFrame:
    return (m if diagonal else off_diagonal(m)).groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(m: DataFrame, *, diagonal: bool = True) -> DataFrame:
    return (m if diagonal else off_diagonal(m)).groupBy("j").agg(F.sum("v").alias("v"))


def row_minima_sum(m: DataFrame, n: int) -> DataFrame:
    """The sum of the rows' least cells of an n by n matrix; a row with a missing cell has 0 among its cells."""
    low = m.groupBy("i").agg(F.min("v").alias("v"), F.count("*").alias("c"))
    return low.agg(F.coalesce(F.sum(F.when(F.col("c") < n, F.least("v", F.lit(0.0))).otherwise(F.col("v"))), F.lit(0.0)).alias("v"))


def column_minima_sum(m: DataFrame, n: int) -> DataFrame:
    return row_minima_sum(transpose(m), n)


def without_place(v: DataFrame, place: int) -> DataFrame:
    """A vector (i, v) without one element; later ones move up."""
    return v.where(F.col("i") != place).withColumn("i", F.when(F.col("i") > place, F.col("i") - 1).otherwise(F.col("i")))


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.sum("v").alias("v"))


def divide_by_diagonal(m: DataFrame) -> DataFrame:
    """Each column over its diagonal cell."""
    d = diagonal(m).select(F.col("i").alias("j"), F.col("v").alias("d"))
    return m.join(d, "j").select("i", "j", F.try_divide("v", "d").alias("v"))


def column_probability(m: DataFrame) -> DataFrame:
    return m.withColumn("v", F.coalesce(F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("j"))), F.lit(0.0)))


def positive_divide(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def keep_above(m: DataFrame, t: float, other: float = 0.0, *, transposed: bool = False) -> DataFrame:
    """Cells above t, others replaced; transposed as the dense kernel has it."""
    out = m.withColumn("v", F.when(F.col("v") > t, F.col("v")).otherwise(F.lit(other)))
    return transpose(out) if transposed else out


def indexed_terms(terms: DataFrame) -> DataFrame:
    """(term, index) from 0 in the order of the terms of a bounded list."""
    return terms.select("term").distinct().withColumn("index", F.row_number().over(Window.orderBy("term")) - 1)


def to_indices(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Cells (x, y, n) of terms as cells of indices; unknown terms are left out."""
    a, b = (index.select(F.col("term").alias(t), F.col("index").alias(k)) for t, k in (("x", "i"), ("y", "j")))
    return cells.join(a, "x").join(b, "y").select("i", "j", F.col("n").alias("v"))


def labels_of(index: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """(key, label): indices of each row's array as terms joined by bars, in the array's order."""
    each = sets.select(key, F.posexplode("indices").alias("at", "index")).join(index, "index")
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), " | ").alias("label"))


def truncated(value: str, n: int) -> Column:
    k = F.pow(F.lit(10.0), F.lit(n))
    return F.floor(F.col(value) * k) / k


def larger_direction(m: DataFrame) -> DataFrame:
    """Of (i, j) and (j, i) the larger cell, where i comes before j on ties."""
    best = m.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(F.struct("v", (F.col("i") < F.col("j")).alias("f"), "i", "j")).alias("m"))
    return best.select("m.i", "m.j", "m.v")


def common_prefix(a: str, b: str) -> Column:
    """The longest common beginning of two arrays."""
    same = F.transform(F.arrays_zip(a, b), lambda z: z[a].eqNullSafe(z[b]))
    at = F.array_position(same, False)
    shortest = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), F.when(at > 0, at.cast("int") - 1).otherwise(shortest))


def principal_components(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """rows with `components`: their projections on the k directions of greatest variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("components", vector_to_array("_p")).drop("_v", "_p")
