"""Order and time: local maxima, running sums, date scales, run-length counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_maxima(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rows whose value is above those on both sides, in the order of x (of each group)."""
    w = Window.partitionBy(*by).orderBy(x)
    return df.withColumn("_a", F.lag(y).over(w)).withColumn("_b", F.lead(y).over(w)).where((F.col(y) > F.col("_a")) & (F.col(y) > F.col("_b"))).drop("_a", "_b")


def running_before(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """With `before`: the sum of all earlier values."""
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(y).over(w), F.lit(0)))


def date_scale(spark: SparkSession, first: int, last: int, step: int) -> DataFrame:
    return spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("date"))


def time_unit(date: str, unit: str) -> Column:
    """A date as a number of years, months, weeks or days from the year 0."""
    zero = F.make_date(F.lit(0), F.lit(1), F.lit(1))
    return {"year": F.year(date), "month": (F.year(date) * 12 + F.month(date) - 1), "week": F.floor(F.datediff(date, zero) / 7).cast("int"), "day": F.datediff(date, zero)}[unit]


def group_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def positive_argmax(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """The key of greatest value in each group, if it is above 0; ties to the smaller key."""
    best = df.groupBy(group).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))).alias("b"))
    return best.where("b.v < 0").select(group, F.col("b.k").alias(key))


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n): runs of events without a gap, an extension over the events table."""
    return events.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
