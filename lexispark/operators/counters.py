"""Counts that the reference model keeps by triggers, as signed changes summed by key: equal to recomputing the aggregate.

The same functions run on a table of changes or, by the streaming module, on a stream of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_occurrences(occ: DataFrame, parents: DataFrame) -> DataFrame:
    """(corpus, list, term, n): documents by corpus, list and term."""
    return occ.join(parents.select("context_id", "corpus"), "context_id").groupBy("corpus", "list", "term").agg(F.count("*").alias("n"))


def category_change(old: str, new: str):
    """+1 when a document leaves the trash, -1 when it goes there; a null old category is a new link, a null new one a deleted link."""
    live = lambda c: F.coalesce(F.col(c) >= 1, F.lit(False)).cast("int")
    return live(new) - live(old)


def after_changes(changes: DataFrame, occ: DataFrame) -> DataFrame:
    """(corpus, term, n) from changes of links (corpus, context_id, old, new) and occurrences (context_id, term)."""
    d = changes.select("corpus", "context_id", category_change("old", "new").alias("d")).where("d <> 0")
    return d.join(occ.select("context_id", "term"), "context_id").groupBy("corpus", "term").agg(F.sum("d").alias("n")).where("n <> 0")


def sampled(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """n rows by hash order: the same ones each time."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def unused(links: DataFrame, key: str) -> DataFrame:
    from .relations import used_once

    return used_once(links, key)
