"""Full-text search over documents: matches of any or all words, terms of a document, ranked search by fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import tokens

#: Parameters of the ranked search, by field: weight, length normalisation. Fixed values.
BM25F_FIELDS = {"title": (20.0, 0.9), "abstract": (5.0, 0.5)}
BM25F_K1 = 1.5
#: Soft and hard limits of results.
RESULT_LIMITS = (2000, 4000)


def stems_of(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Distinct stems of each document as an array; none where there are no words. Keys are unique. The distinct words of each language are stemmed once and joined."""
    from ..functions.stem import stem_udf

    words = docs.select(key, F.col(lang), F.explode_outer(F.array_distinct(tokens(text))).alias("word"))
    known = words.where("word IS NOT NULL").select(lang, "word").distinct().withColumn("stem", stem_udf()("word", lang))
    known = known.select(F.col(lang).alias("_lang"), F.col("word").alias("_word"), "stem")
    both = words.join(known, (F.col("word") == F.col("_word")) & F.col(lang).eqNullSafe(F.col("_lang")), "left")
    return both.groupBy(key).agg(F.array_sort(F.collect_set("stem")).alias("stems"))


def query_stems(query: str, lang: str = "en") -> list[str]:
    import re

    return sorted({stem(w, lang) for w in re.split(r"[,.:;?!(){}\[\]\"'\s]+", query.lower()) if w})


def match_any(stems: DataFrame, words: list[str]) -> DataFrame:
    return stems.where(F.arrays_overlap("stems", F.array(*map(F.lit, words)))) if words else stems.limit(0)


def match_all(stems: DataFrame, words: list[str]) -> DataFrame:
    return stems.where(F.size(F.array_except(F.array(*map(F.lit, words)), F.col("stems"))) == 0) if words else stems.limit(0)


def terms_in_document(terms: DataFrame, document_stems: list[str]) -> DataFrame:
    """Those of the terms (term, stems) all of whose stems a document has."""
    return terms.where(F.size(F.array_except("stems", F.array(*map(F.lit, document_stems)))) == 0).distinct()


def inverted_index(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """(key, field, term, tf, length): the ranked search reads nothing else."""
    parts = [docs.select(key, F.lit(f).alias("field"), tokens(f).alias("words")) for f in fields]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select(key, "field", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy(key, "field", "term", "length").agg(F.count("*").alias("tf"))


def bm25f(docs: DataFrame, query: list[str], key: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Documents by the weighted, length-normalised frequencies of the query's words. Only rows of these words are shuffled."""
    fields = list(BM25F_FIELDS)
    lengths = docs.select(key, *[F.size(tokens(f)).alias(f"n_{f}") for f in fields], *[F.filter(tokens(f), lambda w: w.isin(query)).alias(f"w_{f}") for f in fields])
    stats = lengths.agg(F.count("*").alias("total"), *[F.avg(f"n_{f}").alias(f"avg_{f}") for f in fields])
    parts = [lengths.select(key, F.lit(f).alias("field"), F.col(f"n_{f}").alias("length"), F.explode(f"w_{f}").alias("term")) for f in fields]
    hits = parts[0].unionByName(parts[1]).groupBy(key, "field", "length", "term").agg(F.count("*").alias("tf")).crossJoin(F.broadcast(stats))
    weight, part, average = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    for f in fields:
        w, b = BM25F_FIELDS[f]
        weight, part, average = F.when(F.col("field") == f, w).otherwise(weight), F.when(F.col("field") == f, b).otherwise(part), F.when(F.col("field") == f, F.col(f"avg_{f}")).otherwise(average)
    by_term = hits.groupBy(key, "term", "total").agg(F.sum(weight * F.col("tf") / (1 + part * (F.col("length") / average - 1))).alias("x"))
    df = by_term.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    ranked = by_term.join(F.broadcast(df), "term").groupBy(key).agg(F.round(F.sum(idf * F.col("x") / (BM25F_K1 + F.col("x"))), 6).alias("score"))
    return ranked if limit is None else ranked.orderBy(F.desc("score"), key).limit(limit)
