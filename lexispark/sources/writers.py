"""Sinks: documents, lists, corpora, graphs and counts in the exchange formats. Rows are written by tasks; only graphs of a bounded list become one file."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import CSV_COLUMNS


def write_csv(docs: DataFrame, path: str) -> None:
    """Tab-separated, the seven columns of the corpus format."""
    docs.select(*CSV_COLUMNS).write.mode("overwrite").csv(path, sep="\t", header=True, escape='"', quote='"')


def write_json(docs: DataFrame, path: str, version: str = "1") -> None:
    docs.withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def corpus_rows(docs: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, ngrams, hash): documents with their map terms; the hash covers both."""
    own = terms.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("ngrams"))
    d = docs.join(own, key)
    ngrams_hash = F.sha2(F.array_join("ngrams", ""), 256)
    return d.select(F.struct(*docs.columns).alias("document"), F.struct("ngrams", ngrams_hash.alias("hash")).alias("ngrams"), F.sha2(F.concat(F.col(key).cast("string"), ngrams_hash), 256).alias("hash"))


def corpus_hash(rows: DataFrame) -> str:
    """A hash of a corpus that doesn't depend on the order of its rows: hashes are summed, not gathered."""
    part = lambda i: F.sum(F.conv(F.substring("hash", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    sums = rows.agg(*[part(i).alias(f"h{i}") for i in range(8)]).first()
    import hashlib

    return hashlib.sha256("-".join(str(x) for x in sums).encode()).hexdigest()


def write_corpus(docs: DataFrame, terms: DataFrame, path: str, key: str = "doc_id") -> None:
    corpus_rows(docs, terms, key).write.mode("overwrite").json(path)


def write_list_json(state: DataFrame, path: str, version: int = 1) -> None:
    state.withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def term_list_rows(state: DataFrame) -> DataFrame:
    """(status, label, forms) of the roots of a list."""
    kind = F.when(F.col("list") == "MapTerm", "map").when(F.col("list") == "StopTerm", "stop").otherwise("main")
    return state.where("root IS NULL").select(kind.alias("status"), F.col("term").alias("label"), F.array_join(F.coalesce("children", F.array().cast("array<string>")), "|&|").alias("forms"))


def write_term_list(state: DataFrame, path: str) -> None:
    term_list_rows(state).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_cooc(cooc: DataFrame, path: str) -> None:
    cooc.write.mode("overwrite").json(path)


def write_by_hash(rows: DataFrame, path: str, column: str = "hash") -> None:
    """Content-addressed: folders by the first letters of the hash."""
    rows.withColumn("prefix", F.substring(column, 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(path)


def _bounded(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}: too many for one graph file")
    return rows


def gexf(nodes: DataFrame, edges: DataFrame, *, most: int = 200_000) -> str:
    """A graph of a term list as GEXF 1.3: nodes (id, label, size), edges (src, dst, weight)."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.3" version="1.3"><graph mode="static" defaultedgetype="undirected"><nodes>']
    out += [f"<node id={quoteattr(str(r['id']))} label={quoteattr(str(r['label']))}><size value={quoteattr(str(r['size']))}/></node>" for r in _bounded(nodes.orderBy("id"), most, "nodes")]
    out.append("</nodes><edges>")
    out += [f"<edge id={quoteattr(str(k))} source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))} weight={quoteattr(str(r['weight']))}/>" for k, r in enumerate(_bounded(edges.orderBy("src", "dst"), most, "edges"))]
    return "\n".join([*out, "</edges></graph></gexf>"])


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines (value) of a graph of any size as GEXF 1.3, in order: written as text, the parts in a row are the file."""
    def quoted(c):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(plain), F.lit(entity))
        return F.concat(F.lit('"'), text, F.lit('"'))

    spark = nodes.sparkSession
    frame = [(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<gexf xmlns="http://www.gexf.net/1.3" version="1.3"><graph mode="static" defaultedgetype="undirected"><nodes>'), (3, "</nodes><edges>"), (5, "</edges></graph></gexf>")]
    fixed = spark.createDataFrame([(a, "", "", v) for a, v in frame], "part int, a string, b string, value string")
    node = F.concat(F.lit("<node id="), quoted("id"), F.lit(" label="), quoted("label"), F.lit("><size value="), quoted("size"), F.lit("/></node>"))
    edge = F.concat(F.lit("<edge id="), F.concat(F.lit('"'), F.abs(F.xxhash64("src", "dst")).cast("string"), F.lit('"')), F.lit(" source="), quoted("src"), F.lit(" target="), quoted("dst"), F.lit(" weight="), quoted("weight"), F.lit("/>"))
    rows = nodes.select(F.lit(2).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("a"), F.lit("").alias("b"), node.alias("value"))
    rows = rows.unionByName(edges.select(F.lit(4).alias("part"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), edge.alias("value")))
    return rows.unionByName(fixed).orderBy("part", "a", "b").select("value")


def hashed(payload: str):
    """(hash, value) of a JSON payload, as answers carry them so that a client can tell whether they changed."""
    return F.struct(F.sha2(F.col(payload), 256).alias("hash"), F.col(payload).alias("value"))


def dot(groups: DataFrame, links: DataFrame, *, most: int = 200_000) -> str:
    """A temporal graph as DOT: groups (id, first, label), links (src, dst, similarity)."""
    q = lambda x: '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = ["digraph phylo {", "rankdir=TB;"]
    for r in _bounded(groups.orderBy("id"), most, "groups"):
        out.append(f"{q(r['id'])} [label={q(r['label'])}, period={q(r['first'])}];")
    for r in _bounded(links.orderBy("src", "dst"), most, "links"):
        out.append(f"{q(r['src'])} -> {q(r['dst'])} [weight={r['similarity']:.6f}];")
    return "\n".join([*out, "}"])
