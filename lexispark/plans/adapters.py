"""The data set's tables as the model's: documents with titles and years, links with categories, occurrences, lists, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import occurrences as occ
from ..operators.graph import checkpoint_dir
from ..sources.splits import read_spread

#: Terms of a map list, and of the list that the cubic kernel and searches of cliques run on.
MAP_TERMS, KERNEL_TERMS = 1000, 60


#: Tables of long texts, whose work is in the scan's own stage.
TEXTS = {"documents", "pages"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_spread(spark, path) if name in TEXTS else spark.read.parquet(path)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The pattern stands for a single file as well as for a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/{name}.parque[t]")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the title is the first line, the year follows from the id."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"), "lang", "source", (F.lit(1990) + F.col("doc_id") % 30).cast("int").alias("year"), F.col("n_chars").cast("double").alias("score")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus membership: favourite if of quality 1, trash if toxic, else neutral."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), read(spark, sf_dir, "labels")
    category = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return d.join(lab, "doc_id", "left").select(F.col("source").alias("corpus"), F.col("doc_id").alias("context_id"), category.alias("category"), F.col("n_chars").cast("double").alias("link_score"))


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, term, doc_count) of all documents."""
    return occ.occurrences(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", "text", "lang")


def row_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, terms) of all documents: the distinct words of each."""
    return occ.distinct_terms(read(spark, sf_dir, "documents"), "text", "doc_id", "lang", "source")


def map_terms(spark: SparkSession, sf_dir: str, n: int = MAP_TERMS) -> DataFrame:
    """The map list: the n terms of most documents."""
    return occ.top_terms(occ.row_frequency(row_terms(spark, sf_dir)), n).select("term")


def map_cooc(spark: SparkSession, sf_dir: str, n: int = MAP_TERMS) -> DataFrame:
    """Co-occurrence (x >= y, n) of the map list over all documents. The queries that read it use it several times, so it is kept once counted."""
    checkpoint_dir(spark)
    return occ.list_cooccurrence(row_terms(spark, sf_dir), map_terms(spark, sf_dir, n)).checkpoint()


def node_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer, orders as a tree (id, parent_id, typename, name) under one root."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("root").alias("parent_id"), F.lit(2).alias("typename"), F.col("r_name").alias("name"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(30), F.col("n_name"))
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.lit(31), F.col("c_name"))
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit(4), F.col("o_orderstatus"))
    root = spark.createDataFrame([("root", None, 1, "root")], "id string, parent_id string, typename int, name string")
    return root.union(r).union(n).union(c).union(o)
