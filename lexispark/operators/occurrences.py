"""Terms in documents: occurrence tables, counts, rankings, co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def explode_terms(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row for each word of each document; generated without a shuffle."""
    return docs.select(*keep, F.explode(tokens(text)).alias("term"))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", *keep: str) -> DataFrame:
    """(key, term, doc_count): how often a document holds a term. Counted on the map side before the shuffle."""
    return explode_terms(docs, text, key, *keep).groupBy(key, *keep, "term").agg(F.count("*").alias("doc_count"))


def document_frequency(occ: DataFrame, key: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Documents of each term. Rows of occ are unique by document and term."""
    return occ.groupBy(*by, "term").agg(F.count(key).alias("n_docs"))


def distinct_terms(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Rows of docs with `terms`, the distinct words of each; nothing is shuffled."""
    return docs.select(*keep, F.array_distinct(tokens(text)).alias("terms"))


def row_frequency(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, term, n_docs) of rows with `terms`: each row is a document, so counts are added up on the map side and shuffled once, by term."""
    return rows.select(*by, F.explode("terms").alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n_docs"))


#: Terms of a list up to which pairs are counted in square tables, one in each task and group: 4 bytes a pair.
SQUARE = 4096


def list_cooccurrence(rows: DataFrame, vocabulary: DataFrame, by: str | None = None, *, diagonal: bool = True) -> DataFrame:
    """(by, x, y, n) with x >= y: in how many rows (with `terms`, distinct) both terms of a bounded list are. vocabulary: term (and by).

    For a list of SQUARE terms or fewer (of each group, of which there must be few) a task adds the pairs of its rows into a square
    table and hands on the cells that aren't 0: neither words nor pairs are shuffled, only these sums. Longer lists are counted by `cooccurrence`.
    """
    import numpy as np
    import pyarrow as pa

    names: dict[str, list[str]] = {}
    few = vocabulary.select(*([by] if by else []), "term").limit(64 * SQUARE + 1).collect()
    for r in sorted(few, key=lambda r: r["term"]):
        names.setdefault(r[by] if by else "", []).append(r["term"])
    keep = [by] if by else []
    if len(few) > 64 * SQUARE or any(len(v) > SQUARE for v in names.values()):
        each = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keep, F.explode("terms").alias("term"))
        return cooccurrence(each.join(vocabulary.select(*keep, "term").distinct(), [*keep, "term"], "left_semi"), "_row", "term", tuple(keep), diagonal=diagonal)
    held = rows.sparkSession.sparkContext.broadcast({g: {t: i for i, t in enumerate(dict.fromkeys(v))} for g, v in names.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        square = {}
        for batch in batches:
            groups = batch.column(1).to_pylist() if by else [""] * batch.num_rows
            for g, terms in zip(groups, batch.column(0).to_pylist()):
                own = places.get(g)
                if own is None or not terms:
                    continue
                at = np.array([i for t in terms if (i := own.get(t)) is not None], dtype=np.int64)
                if g not in square:
                    square[g] = np.zeros((len(own), len(own)), dtype=np.int32)
                square[g][np.ix_(at, at)] += 1
        for g, table in square.items():
            words = np.array(list(places[g]), dtype=object)
            x, y = np.nonzero(np.tril(table, 0 if diagonal else -1))
            for k in range(0, len(x), 50_000):
                a, b = x[k : k + 50_000], y[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(a), pa.string()), pa.array(words[a], pa.string()), pa.array(words[b], pa.string()), pa.array(table[a, b], pa.int64())], names=["g", "x", "y", "n"])

    cells = rows.select("terms", *([F.col(by).cast("string").alias(by)] if by else [])).mapInArrow(run, "g string, x string, y string, n long")
    cells = cells.withColumnRenamed("g", by) if by else cells.drop("g")
    return cells.groupBy(*keep, "x", "y").agg(F.sum("n").alias("n"))


def top_terms(df: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n terms of most documents (of each group); ties by term."""
    if not by:
        return df.orderBy(F.desc("n_docs"), "term").limit(n)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_docs"), "term"))).where(F.col("rank") <= n)


def zero_filled(terms: DataFrame, occ: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every term asked for with the number of its documents, 0 if none."""
    found = occ.join(F.broadcast(terms), "term", "left_semi") if small(terms) else occ.join(terms, "term", "left_semi")
    return terms.join(found.groupBy("term").agg(F.countDistinct(key).alias("n_docs")), "term", "left").select("term", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table has no more than so many rows: what may be broadcast. Reads no further than the bound."""
    return df.limit(rows + 1).count() <= rows


def merge_synonyms(occ: DataFrame, roots: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences under each term's root (term, root); terms without one stand for themselves."""
    return occ.join(roots, "term", "left").select(key, F.coalesce("root", "term").alias("term"), "doc_count").groupBy(key, "term").agg(F.sum("doc_count").alias("doc_count"))


def document_scores(occ: DataFrame, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many of the terms each document holds."""
    return occ.join(terms, "term", "left_semi").groupBy(key).agg(F.countDistinct("term").alias("score"))


def with_all_terms(occ: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Documents that hold all of the terms, by their share of the document's words, greatest first."""
    own = occ.where(F.col("term").isin(terms)).groupBy(key).agg(F.countDistinct("term").alias("n"), F.sum("doc_count").alias("hits")).where(F.col("n") == len(set(terms)))
    size = occ.join(own.select(key), key, "left_semi").groupBy(key).agg(F.sum("doc_count").alias("size"))
    return own.join(size, key).select(key, F.round(F.col("hits") / F.col("size"), 6).alias("tf"))


def top_context(occ: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each term the document that holds it most often; ties to the smaller id. A partial aggregate, not a sort."""
    return occ.groupBy("term").agg(F.max(F.struct(F.col("doc_count"), (-F.col(key)).alias("k"))).alias("best")).select("term", (-F.col("best.k")).alias(key), F.col("best.doc_count").alias("doc_count"))


def cooccurrence(items: DataFrame, context: str = "doc_id", item: str = "term", by: tuple[str, ...] = (), *, diagonal: bool = True) -> DataFrame:
    """(by, x, y, n) with x >= y: in how many contexts both items are. items needs only distinct rows of a bounded vocabulary: the pairs of a context grow with the square of its items.

    The items of a context are gathered as one sorted array and pairs made from it, so the table is shuffled once, not joined with itself.
    """
    own = items.select(*by, context, item).groupBy(*by, context).agg(F.array_sort(F.collect_set(item)).alias("items"))
    first = own.select(*by, "items", F.posexplode("items").alias("i", "x"))
    pairs = first.select(*by, "x", F.explode(F.slice("items", F.lit(1), F.col("i") + (1 if diagonal else 0))).alias("y")) if diagonal else first.where("i > 0").select(*by, "x", F.explode(F.slice("items", F.lit(1), F.col("i"))).alias("y"))
    return pairs.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))


def by_frequency(occ: DataFrame, least: int, most: int, key: str = "doc_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of terms that least..most documents (of their group) hold."""
    df = document_frequency(occ, key, by).where(F.col("n_docs").between(least, most))
    return occ.join(df.select(*by, "term"), [*by, "term"], "left_semi")


def date_gap_fill(df: DataFrame, date: str, value: str, first: int, last: int, step: int = 1) -> DataFrame:
    """A count for every date from first to last, 0 where there is none."""
    dates = df.sparkSession.range(first, last + 1, step).select(F.col("id").alias(date))
    return dates.join(df, date, "left").select(date, F.coalesce(value, F.lit(0)).alias(value))


def inverted(df: DataFrame, key: str, value: str) -> DataFrame:
    """From key -> set of values to value -> set of keys."""
    return df.select(key, F.explode(value).alias(value)).groupBy(value).agg(F.array_sort(F.collect_set(key)).alias(key))


def normalised_frequency(df: DataFrame, total: int) -> DataFrame:
    """(df / N) over the sum of all terms' (df / N)."""
    whole = df.agg(F.sum(F.col("n_docs") / total).alias("_whole"))
    return df.crossJoin(F.broadcast(whole)).select("term", (F.col("n_docs") / total / F.col("_whole")).alias("frequency"))


def argmax(df: DataFrame, key: str, value: str) -> DataFrame:
    """All keys that reach the greatest value."""
    top = df.agg(F.max(value).alias("_top"))
    return df.join(F.broadcast(top), F.col(value) == F.col("_top")).select(key, value)


def counts_by_root(occ: DataFrame, roots: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, n_docs): distinct documents of each root over all its forms, as a pie or histogram of a list shows them."""
    return merge_synonyms(occ, roots, key).groupBy("term").agg(F.countDistinct(key).alias("n_docs"))


def recent_frequency(occ: DataFrame, dates: DataFrame, n: int, key: str = "doc_id", date: str = "date") -> DataFrame:
    """(term, n_docs) over the documents of the dates that the n most recent documents have."""
    latest = dates.orderBy(F.desc(date), key).limit(n).select(date).distinct()
    recent = dates.join(F.broadcast(latest), date, "left_semi").select(key)
    return occ.join(recent, key, "left_semi").groupBy("term").agg(F.countDistinct(key).alias("n_docs"))


def by_stem(occ: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, stem, label, n): occurrences by language and stem, labelled by the most frequent form, ties to the smaller. Distinct terms are stemmed once each."""
    from ..functions.stem import stem_udf

    counts = occ.groupBy(lang, "term").agg(F.sum("doc_count").alias("c"))
    return counts.withColumn("stem", stem_udf()("term", lang)).groupBy(lang, "stem").agg(F.min_by("term", F.struct(-F.col("c"), "term")).alias("label"), F.sum("c").alias("n"))


def bipartite(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """(x, y, n): contexts that hold an item of one kind and an item of the other: a (key, x), b (key, y)."""
    return a.distinct().join(b.distinct(), key).groupBy("x", "y").agg(F.count("*").alias("n"))


def mapped_counts(df: DataFrame, values: str, mapping: DataFrame, key: str, name: str) -> DataFrame:
    """(name, n): rows by the name of each of their values, or the value itself, most first."""
    each = df.select(F.explode(values).alias(key)).join(mapping.select(key, name), key, "left")
    return each.groupBy(F.coalesce(name, key).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def mean_size(docs: DataFrame, text: str = "abstract") -> DataFrame:
    return docs.agg(F.avg(F.length(text)).alias("mean"))
