"""Joins, set operations and table changes. Tables are immutable: a change returns the table as it is after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_chain(first: DataFrame, *steps: tuple[DataFrame, Column | str | list[str]]) -> DataFrame:
    """first left-joined with each table in turn: chains of any length."""
    return reduce(lambda df, step: df.join(step[0], step[1], "left"), steps, first)


def nested_left(*steps: tuple[DataFrame, Column | None]) -> DataFrame:
    """q1 left (q2 left (q3 ...)): the condition of each table ties it with the rest on its right."""
    frames = list(steps)
    out = frames[-1][0]
    for df, on in reversed(frames[:-1]):
        out = df.join(out, on, "left")
    return out


def product_filter(condition: Column, *frames: DataFrame) -> DataFrame:
    """A product under a condition, which is an inner join; the optimiser turns its equalities into join keys."""
    return reduce(lambda a, b: a.join(b), frames).where(condition)


def optional_restrict(df: DataFrame, other: DataFrame, on: Column, predicate: Column, key: str) -> DataFrame:
    """Left join whose right side is restricted: rows without a partner pass."""
    return df.join(other, on, "left").where(F.col(key).isNull() | predicate)


def fuzzy_nearest(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """For each row of left the row of right of least edit distance, at most `most`, in lower case; ties to the smaller text.

    Candidates share one of `most` + 1 pieces: if two texts differ by d edits and one is cut into d + 1
    pieces, one piece stands in the other unchanged, at a place moved by d at most. So the join is by equality of (piece, text), not a product.
    """
    low_a, low_b = F.lower(a), F.lower(b)
    pieces = most + 1

    def cut(i: int) -> Column:
        # piece i of a text of length n: from floor(i n / p) to floor((i + 1) n / p)
        n = F.length(low_a)
        start = F.floor(n * i / pieces)
        return F.struct(F.lit(i).alias("i"), n.cast("int").alias("n"), F.substring(low_a, (start + 1).cast("int"), (F.floor(n * (i + 1) / pieces) - start).cast("int")).alias("piece"))

    l_keys = left.withColumn("_a", low_a).withColumn("_k", F.explode(F.array(*[cut(i) for i in range(pieces)]))).select("*", "_k.*").drop("_k")
    # every place at which such a piece of a text of length n can stand in b
    r = right.withColumn("_b", low_b)
    n = F.explode(F.sequence(F.greatest(F.lit(0), F.length("_b") - most), F.length("_b") + most)).alias("n")
    r = r.select("*", n)
    starts = lambda i: F.floor(F.col("n") * i / pieces)
    size = lambda i: F.floor(F.col("n") * (i + 1) / pieces) - starts(i)
    places = [F.struct(F.lit(i).alias("i"), F.when(starts(i) + shift >= 0, F.substring("_b", (starts(i) + shift + 1).cast("int"), size(i).cast("int"))).alias("piece")) for i in range(pieces) for shift in range(-most, most + 1)]
    r_keys = r.withColumn("_k", F.explode(F.array_distinct(F.array(*places)))).select("*", "_k.i", "_k.piece").drop("_k")
    near = l_keys.join(r_keys, ["i", "n", "piece"]).withColumn("distance", F.levenshtein("_a", "_b")).where(F.col("distance") <= most)
    keep = [c for c in left.columns] + [c for c in right.columns]
    best = Window.partitionBy(*left.columns).orderBy("distance", *right.columns)
    return near.select(*keep, "distance").distinct().withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with those rows whose key it hasn't yet; of repeated new rows one is taken."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti").select(*table.columns))


def upsert_report(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every distinct new row's key, and whether it is new."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    return rows.select(key).distinct().join(known, key, "left").select(key, F.col("_known").isNull().alias("is_new"))


def update_from(table: DataFrame, values: DataFrame, key: list[str], column: str) -> DataFrame:
    """UPDATE ... FROM VALUES: the column's new value where there is one."""
    new = values.select(*key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `rows` in place of those with the same key, and the rest."""
    return table.join(rows.select(*key), key, "left_anti").select(*table.columns).unionByName(rows.dropDuplicates(key).select(*table.columns))


def delete_by(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on), on, "left_anti").select(*table.columns)


def merge_json(old: str, new: str) -> Column:
    """Two JSON objects as one; keys of the new one win. Values stay JSON texts of strings."""
    o, n = (F.from_json(c, "map<string,string>") for c in (old, new))
    kept = F.map_filter(o, lambda k, v: ~F.map_contains_key(n, k))
    return F.to_json(F.map_concat(kept, n))


def node_hash(secret: str, *columns: str) -> Column:
    return F.sha2(F.concat_ws("", F.lit(secret), *[F.col(c).cast("string") for c in columns]), 256)


def used_once(links: DataFrame, key: str) -> DataFrame:
    """Keys that no more than one link names: what a cleanup removes."""
    return links.groupBy(key).agg(F.count("*").alias("n")).where("n <= 1").select(key)


def pair_tables(a: DataFrame, b: DataFrame, on: str, x: str, y: str) -> DataFrame:
    """Pairs (x of a, y of b) of two link tables through what both link."""
    return a.select(F.col(x), on).join(b.select(F.col(y), on), on).select(x, y).distinct()


def changed(old: DataFrame, new: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, change): insert, delete or update of each key that differs."""
    o = old.select(key, F.struct(*values).alias("_o"))
    n = new.select(key, F.struct(*values).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("update")
    return o.join(n, key, "full").where(~F.col("_o").eqNullSafe(F.col("_n"))).select(key, kind.alias("change"))
