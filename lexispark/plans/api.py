"""The table, search and graph endpoints as functions of DataFrames: names dispatch to operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, extraction, graph, search, similarity


def document_table(contexts: DataFrame, links: DataFrame, tab: str = "Docs", *, query: str | None = None, year: int | None = None, order: str = "DateAsc", offset: int = 0, limit: int | None = 10, features: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, count) of a corpus' documents: live ones (Docs), trashed ones (Trash), or those most like favourites (MoreFav) or trash (MoreTrash)."""
    if tab in ("Docs", "Trash"):
        hit = corpus.matching(corpus.in_corpus(contexts, links, trash=tab == "Trash"), query, year)
    elif tab in ("MoreFav", "MoreTrash"):
        if features is None or labels is None:
            raise ValueError(f"{tab} needs features and labels")
        y = labels if tab == "MoreFav" else labels.withColumn("favourite", ~F.col("favourite"))
        near = extraction.more_like(features, y, limit=limit or 3).select(F.col("doc_id").alias("id"), F.col("score").alias("likeness"))
        hit = corpus.in_corpus(contexts, links).join(near, "id")
    else:
        raise ValueError(f"unknown tab {tab}")
    return corpus.page(hit, order, offset, limit, "id"), hit.agg(F.count("*").alias("n"))


def search_documents(docs: DataFrame, words: str, *, match: str = "all", lang: str = "en", key: str = "doc_id") -> DataFrame:
    stems = search.stems_of(docs, key=key)
    q = search.query_stems(words, lang)
    return search.match_all(stems, q) if match == "all" else search.match_any(stems, q)


def term_graph(cooc: DataFrame, *, measure: str = "Conditional", threshold: float = 0.0, strongest: bool = True, bridge: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a term list: links by similarity, communities, bridges between them thinned."""
    cells = similarity.similarity_links(cooc.where("n > 1 OR x = y"), measure=measure, threshold=threshold, strongest=strongest)
    edges = cells.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.col("value").alias("weight"))
    clusters = graph.communities(edges)
    kept = graph.bridge_links(edges, clusters.withColumnRenamed("community", "cluster"), bridge)
    return graph.node_rows(cooc, clusters.select(F.col("node").alias("label"), F.col("community").alias("cluster"))), kept


def graph_is_current(built: int, version: int, *, force: bool = False) -> bool:
    """Whether a graph built from a list's version need not be built again."""
    return built == version and not force
