"""Queries over documents of corpora: filters, facets, pages, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders of a document table by name: column and direction; nulls come last.
DOCUMENT_ORDERS = {
    "DateAsc": ("year", True), "DateDesc": ("year", False), "TitleAsc": ("title", True), "TitleDesc": ("title", False), "ScoreAsc": ("score", True), "ScoreDesc": ("score", False),
    "SourceAsc": ("source", True), "SourceDesc": ("source", False), "TagAsc": ("category", True), "TagDesc": ("category", False), "NgramCountAsc": ("ngram_count", True), "NgramCountDesc": ("ngram_count", False),
}


def ordered(df: DataFrame, order: str, *ties: str, orders: dict[str, tuple[str, bool]] = DOCUMENT_ORDERS) -> DataFrame:
    name, up = orders[order]
    return df.orderBy(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_last(), *ties)


def page(df: DataFrame, order: str, offset: int = 0, limit: int | None = None, *ties: str, orders: dict[str, tuple[str, bool]] = DOCUMENT_ORDERS) -> DataFrame:
    """One page of a table: order, offset, limit. A total order needs a unique tie column."""
    out = ordered(df, order, *ties, orders=orders)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def in_corpus(contexts: DataFrame, links: DataFrame, corpus: str | None = None, *, trash: bool = False, include_unlinked: bool = False) -> DataFrame:
    """Documents with their link's category and score. Live documents have a category of 1 or more, trashed ones 0.

    With include_unlinked, documents without a link pass too, as a left join whose condition takes null for true.
    """
    keep = F.col("category") == 0 if trash else F.col("category") >= 1
    if corpus is not None:
        keep = keep & (F.col("corpus") == corpus)
    if include_unlinked:
        return contexts.join(links, contexts.id == links.context_id, "left").where(F.col("context_id").isNull() | keep)
    return contexts.join(links, contexts.id == links.context_id).where(keep)


def matching(df: DataFrame, query: str | None = None, year: int | None = None) -> DataFrame:
    """Rows whose title or abstract holds a string in any case, and of a year."""
    if query:
        escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        df = df.where(F.col("title").ilike(f"%{escaped}%") | F.col("abstract").ilike(f"%{escaped}%"))
    return df if year is None else df.where(F.col("year") == year)


def facet(df: DataFrame, *by: str, **sums: str) -> DataFrame:
    """Groups with sums of columns: facet(df, "id", ngram_count="doc_count")."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def year_histogram(df: DataFrame, date: str = "date") -> DataFrame:
    """Documents by the first part of their date."""
    return df.groupBy(F.split(F.col(date), "-")[0].alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def children(nodes: DataFrame, parent: int, typename: int | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    out = nodes.where(F.col("parent_id") == parent)
    out = out if typename is None else out.where(F.col("typename") == typename)
    out = out.orderBy("id").offset(offset) if offset else out.orderBy("id")
    return out if limit is None else out.limit(limit)


def of_type(nodes: DataFrame, typename: int) -> DataFrame:
    return nodes.where(F.col("typename") == typename)


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).isEmpty()


def owned_by(nodes: DataFrame, users: DataFrame, name: str) -> DataFrame:
    """Nodes of a user; nodes without a known user are kept."""
    u = users.select(F.col("id").alias("_user"), F.col("username"))
    return nodes.join(u, F.col("user_id") == F.col("_user"), "left").where(F.col("username").isNull() | (F.col("username") == name)).drop("_user", "username")


def json_path(column: str, *keys: str) -> Column:
    return F.get_json_object(column, "$." + ".".join(keys))


def with_defaults(docs: DataFrame) -> DataFrame:
    """Nulls of a document row view as the interface shows them: empty texts, zero counts, the default date."""
    from ..model import DEFAULT_DATE

    fill = {f.name: "" if f.dataType.simpleString() == "string" else 0 for f in docs.schema if f.dataType.simpleString() in ("string", "int", "bigint", "double")}
    fill |= {k: v for k, v in zip(("publication_year", "publication_month", "publication_day"), DEFAULT_DATE) if k in docs.columns}
    return docs.fillna(fill)


def pages_of(df: DataFrame, start: int, size: int, by: str = "typename", key: str = "id") -> DataFrame:
    """Rows whose position by key among those of their kind is from start to start + size."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    return df.withColumn("position", at).where((F.col("position") >= start) & (F.col("position") < start + size))
