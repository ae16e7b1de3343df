"""The registered queries over the data set's tables, and the same in SQL.

Every query reads its whole tables. Names, roundings and tie-breaks are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stem as stems
from ..functions import text as tx
from ..operators import accounts, corpus, counters, extraction, graph, matrix, phylo, relations, search, series, similarity, terms, tree
from ..sources import connectors, writers
from ..streaming import ingest
from ..operators import occurrences as occ
from . import adapters as ad
from . import api

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "cooc_by_lang"

TOK = r"""tok AS (
  SELECT doc_id, lang, source, term FROM (
    SELECT doc_id, lang, source, unnest(string_split_regex(lower(text), '[,.:;?!(){}\[\]"''\s]+')) AS term FROM documents) WHERE term <> ''),
occ AS (SELECT doc_id, lang, term, count(*) AS doc_count FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS n_docs FROM occ GROUP BY term)"""
CTX = r"""ctx AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, lang, source, (1990 + doc_id % 30)::INT AS year, n_chars::DOUBLE AS score FROM documents),
links AS (SELECT d.source AS corpus, d.doc_id AS context_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS category, n_chars::DOUBLE AS link_score FROM documents d LEFT JOIN labels l USING (doc_id))"""
_MAP = """map AS (SELECT term FROM df ORDER BY n_docs DESC, term LIMIT {}),
items AS (SELECT DISTINCT doc_id, term FROM occ WHERE term IN (SELECT term FROM map)),
cooc AS (SELECT a.term AS x, b.term AS y, count(*) AS n FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.term >= b.term GROUP BY ALL),
off AS (SELECT x, y, n FROM cooc WHERE x <> y UNION ALL SELECT y, x, n FROM cooc WHERE x <> y),
diag AS (SELECT x AS t, n AS nt FROM cooc WHERE x = y)"""
MAP, KERNEL = _MAP.format(ad.MAP_TERMS), _MAP.format(ad.KERNEL_TERMS)
NODES = """nodes AS (SELECT 'root' AS id, NULL AS parent_id, 1 AS typename, 'root' AS name
  UNION ALL SELECT 'r' || r_regionkey, 'root', 2, r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 30, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 31, c_name FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 4, o_orderstatus FROM orders)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# ---- terms and co-occurrence


@query(f"""WITH {TOK}, ldf AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM occ GROUP BY lang, term),
own AS (SELECT o.lang, o.doc_id, o.term FROM occ o JOIN ldf USING (lang, term) WHERE r <= {ad.MAP_TERMS})
SELECT a.lang, a.term AS x, b.term AS y, count(*) AS n FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.lang = b.lang AND a.term >= b.term
GROUP BY ALL ORDER BY n DESC, a.lang, x, y LIMIT 1000""")
def cooc_by_lang(spark, d):
    """The thousand most frequent co-occurrences of each language's map list, counted over all documents."""
    rows = ad.row_terms(spark, d)
    lists = occ.top_terms(occ.row_frequency(rows, ("lang",)), ad.MAP_TERMS, ("lang",))
    return occ.list_cooccurrence(rows, lists, "lang").orderBy(F.desc("n"), "lang", "x", "y").limit(1000)


@query(f"WITH {TOK} SELECT term, n_docs FROM df WHERE n_docs > 1")
def term_doc_counts(spark, d):
    return occ.row_frequency(ad.row_terms(spark, d)).where("n_docs > 1")


@query(f"""WITH {TOK}, asked AS (SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(text), '[,.:;?!(){{}}\\[\\]"''\\s]+')) AS term FROM benchmark) WHERE term <> '')
SELECT a.term, coalesce(n_docs, 0) AS n_docs FROM asked a LEFT JOIN df USING (term)""")
def term_docs_zero_fill(spark, d):
    asked = occ.explode_terms(ad.read(spark, d, "benchmark")).distinct()
    return occ.zero_filled(asked, ad.document_terms(spark, d))


@query(f"WITH {TOK}, {MAP} SELECT doc_id, count(DISTINCT term) AS score FROM items GROUP BY doc_id")
def doc_term_scores(spark, d):
    return occ.document_scores(ad.document_terms(spark, d), ad.map_terms(spark, d))


@query(f"""WITH {TOK}, o AS (SELECT doc_id, count(DISTINCT term) FILTER (term IN ('the', 'of', 'and')) AS n, sum(doc_count) FILTER (term IN ('the', 'of', 'and')) AS hits, sum(doc_count) AS size FROM occ GROUP BY doc_id)
SELECT doc_id, round(hits / size, 6) AS tf FROM o WHERE n = 3""")
def docs_with_all_terms_tf(spark, d):
    return occ.with_all_terms(ad.document_terms(spark, d), ["the", "of", "and"])


@query(f"WITH {TOK} SELECT term, doc_id, doc_count FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_count DESC, doc_id) AS r FROM occ) WHERE r = 1")
def top_context_per_term(spark, d):
    return occ.top_context(ad.document_terms(spark, d))


@query(f"""WITH {TOK}, lo AS (SELECT term, count(*) AS n FROM occ WHERE lang = 'en' GROUP BY term HAVING count(*) > 1), t AS (SELECT count(*) AS n FROM documents WHERE lang = 'en')
SELECT lo.term, round(t.n / lo.n * ln(t.n / least(df.n_docs, t.n)), 6) AS score FROM lo JOIN df USING (term), t""")
def tficf_user_vs_master(spark, d):
    """Scores of the English documents' terms against all documents."""
    rows = ad.row_terms(spark, d)
    total = ad.read(spark, d, "documents").where("lang = 'en'").count()
    return similarity.tficf_table(occ.row_frequency(rows.where("lang = 'en'")), occ.row_frequency(rows), total).select("term", F.round("score", 6).alias("score"))


@query(f"WITH {TOK.replace('df AS (', 'df AS MATERIALIZED (')} SELECT term, round(n_docs / (SELECT sum(n_docs) FROM df), 9) AS frequency FROM df")
def term_normalised_frequency(spark, d):
    """Each term's share of documents over the sum of all terms' shares."""
    df = occ.row_frequency(ad.row_terms(spark, d))
    return occ.normalised_frequency(df, ad.read(spark, d, "documents").count()).withColumn("frequency", F.round("frequency", 9))


@query(f"WITH {TOK}, {MAP} SELECT x, y, n FROM cooc WHERE n > 1")
def map_term_cooc(spark, d):
    return ad.map_cooc(spark, d).where("n > 1")


@query(f"""WITH {TOK}, {MAP}, y AS (SELECT unnest(range(1990, 2020)) AS year), p AS (SELECT x, y FROM cooc WHERE x <> y ORDER BY n DESC, x, y LIMIT 20),
c AS (SELECT a.term AS x, b.term AS y, 1990 + a.doc_id % 30 AS year, count(*) AS n FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.term > b.term GROUP BY ALL)
SELECT p.x, p.y, y.year::INT AS year, coalesce(n, 0) AS n FROM p CROSS JOIN y LEFT JOIN c ON c.x = p.x AND c.y = p.y AND c.year = y.year""")
def period_term_cooc_gapfill(spark, d):
    """The twenty strongest pairs by year, 0 where there is none."""
    own = ad.document_terms(spark, d).join(F.broadcast(ad.map_terms(spark, d)), "term", "left_semi").withColumn("year", (F.lit(1990) + F.col("doc_id") % 30).cast("int"))
    yearly = occ.cooccurrence(own.select("year", "doc_id", "term"), by=("year",), diagonal=False)
    top = yearly.groupBy("x", "y").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "x", "y").limit(20).select("x", "y")
    years = spark.range(1990, 2020).select(F.col("id").cast("int").alias("year"))
    return top.join(years, how="cross").join(yearly, ["x", "y", "year"], "left").select("x", "y", "year", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {TOK} SELECT doc_id, count(*) AS n_words, count(DISTINCT term) AS n_terms FROM tok GROUP BY doc_id""")
def words_of_documents(spark, d):
    w = ad.read(spark, d, "documents").select("doc_id", tx.tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_terms")).where("n_words > 0")


# ---- documents: facets, pages, counts


@query(f"WITH {CTX} SELECT id, title, source, year, category, link_score FROM ctx JOIN links ON id = context_id WHERE category >= 1 AND (title ILIKE '%tion%' OR abstract ILIKE '%tion%') ORDER BY year, id LIMIT 50 OFFSET 10")
def doc_facet_page(spark, d):
    live = corpus.in_corpus(ad.contexts(spark, d), ad.links(spark, d))
    return corpus.page(corpus.matching(live, "tion"), "DateAsc", 10, 50, "id").select("id", "title", "source", "year", "category", "link_score")


@query(f"WITH {CTX} SELECT corpus, count(*) AS n FROM ctx JOIN links ON id = context_id WHERE category = 0 GROUP BY corpus")
def doc_trash_count(spark, d):
    return corpus.in_corpus(ad.contexts(spark, d), ad.links(spark, d), trash=True).groupBy("corpus").agg(F.count("*").alias("n"))


@query(f"WITH {CTX} SELECT year::VARCHAR AS year, count(*) AS n FROM ctx GROUP BY year")
def docs_year_histogram(spark, d):
    return corpus.year_histogram(ad.contexts(spark, d).select(F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("date")))


@query(f"WITH {CTX} SELECT source, lang, year, count(*) AS n, round(sum(score), 2) AS total FROM ctx GROUP BY ALL")
def doc_facet_aggregate(spark, d):
    return ad.contexts(spark, d).groupBy("source", "lang", "year").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query(f"WITH {CTX} SELECT count(*) AS n FROM ctx LEFT JOIN links ON id = context_id WHERE context_id IS NULL OR (corpus = 'src0' AND category >= 1)")
def corpus_count_unlinked(spark, d):
    return corpus.in_corpus(ad.contexts(spark, d), ad.links(spark, d), "src0", include_unlinked=True).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'purchase'")
def events_json_path(spark, d):
    return ad.read(spark, d, "events").where("event_type = 'purchase'").select("event_id", "event_type", corpus.json_path("props", "k").alias("k"))


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= round(0.1 * n)""")
def proportional_select(spark, d):
    """The longest tenth of each source's documents."""
    w = Window.partitionBy("source")
    ranked = ad.read(spark, d, "documents").select("doc_id", "source", "n_chars").withColumn("r", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id"))).withColumn("n", F.count("*").over(w))
    return ranked.where("r <= round(0.1 * n)").select("doc_id", "source", "n_chars")


# ---- full text


@query(f"WITH {TOK} SELECT DISTINCT doc_id FROM occ WHERE term IN ('nation', 'that', 'entre')")
def fulltext_or(spark, d):
    words = ad.read(spark, d, "documents").select("doc_id", F.array_distinct(tx.tokens("text")).alias("stems"))
    return search.match_any(words, ["nation", "that", "entre"]).select("doc_id")


@query(f"WITH {TOK} SELECT doc_id FROM occ WHERE term IN ('the', 'that', 'with') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def fulltext_and(spark, d):
    words = ad.read(spark, d, "documents").select("doc_id", F.array_distinct(tx.tokens("text")).alias("stems"))
    return search.match_all(words, ["the", "that", "with"]).select("doc_id")


@query()
def fulltext_stemmed(spark, d):
    """Documents whose stems hold all stems of a query, by their language's stemmer."""
    return search.match_all(search.stems_of(ad.read(spark, d, "documents")), search.query_stems("the things with")).select("doc_id")


@query(r"""WITH f AS (SELECT doc_id, 'title' AS field, list_filter(string_split_regex(lower(split_part(text, chr(10), 1)), '[,.:;?!(){}\[\]"''\s]+'), lambda w: w <> '') AS ws FROM documents
  UNION ALL SELECT doc_id, 'abstract', list_filter(string_split_regex(lower(text), '[,.:;?!(){}\[\]"''\s]+'), lambda w: w <> '') FROM documents),
av AS (SELECT field, avg(len(ws)) AS a FROM f GROUP BY field), n AS (SELECT count(*) AS n FROM documents),
h AS (SELECT doc_id, field, len(ws) AS l, unnest(ws) AS term FROM f),
g AS (SELECT doc_id, field, l, term, count(*) AS tf FROM h WHERE term IN ('the', 'that', 'des') GROUP BY ALL),
x AS (SELECT doc_id, term, sum(CASE WHEN field = 'title' THEN 20 ELSE 5 END * tf / (1 + CASE WHEN field = 'title' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END * (l / a - 1))) AS x FROM g JOIN av USING (field) GROUP BY ALL),
dd AS (SELECT term, count(*) AS df FROM x GROUP BY term)
SELECT doc_id, round(sum(ln((n + 0.5::DOUBLE - df) / (df + 0.5::DOUBLE) + 1) * x / (1.5::DOUBLE + x)), 6) AS score FROM x JOIN dd USING (term), n GROUP BY doc_id""")
def fulltext_ranked(spark, d):
    c = ad.contexts(spark, d).select(F.col("id").alias("doc_id"), "title", "abstract")
    return search.bm25f(c, ["the", "that", "des"])


# ---- similarity and graphs


@query(f"""WITH {TOK}, {MAP}, p AS (SELECT y AS a, x AS b, n, da.nt AS na, db.nt AS nb FROM cooc JOIN diag da ON da.t = y JOIN diag db ON db.t = x WHERE x <> y)
SELECT CASE WHEN n / nb >= n / na THEN a ELSE b END AS x, CASE WHEN n / nb >= n / na THEN b ELSE a END AS y, round(greatest(n / na, n / nb), 6) AS value FROM p""")
def conditional_similarity(spark, d):
    return similarity.conditional(ad.map_cooc(spark, d)).withColumn("value", F.round("value", 6))


CONDITIONAL = "m AS (SELECT x, y, n / sum(n) OVER (PARTITION BY y) AS value FROM off), lim AS (SELECT min(v) AS v FROM (SELECT max(value) AS v FROM m GROUP BY x))"


@query(f"WITH {TOK}, {MAP}, {CONDITIONAL} SELECT x, y, round(value, 6) AS value FROM m, lim WHERE value >= v")
def conditional_matrix_minimax(spark, d):
    return similarity.conditional_matrix(ad.map_cooc(spark, d)).withColumn("value", F.round("value", 6))


@query(f"""WITH {TOK}, {KERNEL}, s AS (SELECT x, sum(n) AS s FROM off GROUP BY x), tot AS (SELECT sum(s) AS total FROM s), t AS (SELECT x AS t FROM s),
mi AS (SELECT a.t AS x, b.t AS y, coalesce(ln(total * n / (sa.s * sb.s)), 0) AS mi FROM t a CROSS JOIN t b LEFT JOIN off ON off.x = a.t AND off.y = b.t JOIN s sa ON sa.x = a.t JOIN s sb ON sb.x = b.t, tot),
v AS (SELECT a.x AS x, b.x AS y, sum(least(a.mi, b.mi)) AS top, sum(a.mi) AS bot FROM mi a JOIN mi b ON a.y = b.y AND a.x <> b.x AND a.y <> a.x AND a.y <> b.x GROUP BY ALL)
SELECT x, y, round(coalesce(top / nullif(bot, 0), 0), 4) AS value FROM v""")
def log_distributional(spark, d):
    return similarity.log_distributional(ad.map_cooc(spark, d, ad.KERNEL_TERMS), keep_all=True).withColumn("value", F.round("value", 4))


@query(f"""WITH {TOK}, {MAP}, p AS (SELECT x, y, n / nt AS p FROM cooc JOIN diag ON t = y), k AS (SELECT count(*) AS k FROM diag),
v AS (SELECT x AS term, (sum(p) - 1) / (any_value(k) - 1) AS v FROM p, k GROUP BY x), h AS (SELECT y AS term, (sum(p) - 1) / (any_value(k) - 1) AS h FROM p, k GROUP BY y)
SELECT term, round(v + h, 6) AS inclusion, round(v - h, 6) AS specificity FROM v JOIN h USING (term)""")
def inclusion_specificity(spark, d):
    return similarity.inclusion_specificity(ad.map_cooc(spark, d)).select("term", F.round("inclusion", 6).alias("inclusion"), F.round("specificity", 6).alias("specificity"))


@query(f"""WITH {TOK}, {MAP}, {CONDITIONAL} SELECT x, y, round(value, 6) AS value FROM m, lim WHERE value >= v AND value > 0 ORDER BY m.value DESC, x, y LIMIT (SELECT round(10 * count(*) * ln(count(*)) ^ 2)::BIGINT FROM diag)""")
def graph_edges_budget(spark, d):
    return similarity.similarity_links(ad.map_cooc(spark, d)).select("x", "y", F.round("value", 6).alias("value"))


@query(f"WITH {TOK}, {MAP} SELECT row_number() OVER (ORDER BY t) - 1 AS id, t AS label, nt AS size, round(sin(row_number() OVER (ORDER BY t) - 1), 6) AS x, round(cos(row_number() OVER (ORDER BY t) - 1), 6) AS y FROM diag")
def graph_nodes_rows(spark, d):
    return graph.node_rows(ad.map_cooc(spark, d)).select(F.col("id").cast("long").alias("id"), "label", "size", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {TOK}, {MAP}, {CONDITIONAL} SELECT x, y, rank FROM (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY value DESC, y)::INT AS rank FROM (SELECT x, y, round(value, 12) AS value FROM m)) WHERE rank <= 5")
def knn_links(spark, d):
    m = similarity.mirrored(ad.map_cooc(spark, d)).withColumn("value", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("y")), 12))
    return similarity.nearest_links(m, 5).select("x", "y", F.col("rank").cast("int").alias("rank"))


@query("""WITH e AS (SELECT DISTINCT cn.c_nationkey AS src, s.s_nationkey AS dst FROM orders o JOIN customer cn ON cn.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE cn.c_nationkey <> s.s_nationkey),
b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)), a AS (SELECT src, dst, 1 / count(*) OVER (PARTITION BY src) AS w FROM b)
SELECT p.src AS start, r.dst AS node, round(sum(p.w * q.w * r.w), 9) AS p FROM a p JOIN a q ON q.src = p.dst JOIN a r ON r.src = q.dst GROUP BY ALL""")
def random_walk_3(spark, d):
    """Walks of three steps on the graph of nations that trade."""
    e = _trade(spark, d)
    starts = graph.both_ways(e).select(F.col("src").alias("node")).distinct()
    return graph.walk(e, starts, 3).select("start", "node", F.round("p", 9).alias("p"))


def _trade(spark, d):
    """(src, dst): nations one of whose customers ordered from a supplier of the other."""
    o, c, s, lines = (ad.read(spark, d, t) for t in ("orders", "customer", "supplier", "lineitem"))
    e = lines.join(o, lines.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, lines.l_suppkey == s.s_suppkey)
    return e.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).where("src <> dst").distinct()


# ---- joins, trees, changes


@query(f"""WITH RECURSIVE {NODES}, t AS (SELECT id, 0 AS depth FROM nodes WHERE id = 'root' UNION ALL SELECT n.id, depth + 1 FROM t JOIN nodes n ON n.parent_id = t.id)
SELECT depth::INT AS depth, count(*) AS n FROM t GROUP BY depth""")
def tree_descendants(spark, d):
    nodes = ad.node_tree(spark, d)
    return tree.descendants(nodes, nodes.where("id = 'root'").select("id")).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, o AS (SELECT id, parent_id FROM nodes WHERE typename = 4) SELECT o.id, n.id AS closest FROM o JOIN nodes c ON c.id = o.parent_id JOIN nodes n ON n.id = c.parent_id AND n.typename = 30""")
def tree_ancestor_of_type(spark, d):
    nodes = ad.node_tree(spark, d)
    return tree.closest_of_type(nodes, nodes.where("typename = 4").select("id"), 30)


@query("""SELECT r_name, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def left_join_chain_5(spark, d):
    r, n, c, o, li = (ad.read(spark, d, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    chain = relations.left_chain(r, (n, F.col("n_regionkey") == F.col("r_regionkey")), (c, F.col("c_nationkey") == F.col("n_nationkey")), (o, F.col("o_custkey") == F.col("c_custkey")), (li, F.col("l_orderkey") == F.col("o_orderkey")))
    return chain.groupBy("r_name").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH c AS (SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS a FROM customer), s AS (SELECT s_suppkey, regexp_replace(s_name, '[^0-9]', '', 'g') AS b FROM supplier),
j AS (SELECT c_custkey, s_suppkey, levenshtein(a, b) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY levenshtein(a, b), s_suppkey) AS r FROM c JOIN s ON levenshtein(a, b) <= 1)
SELECT c_custkey, s_suppkey, distance::INT AS distance FROM j WHERE r = 1""")
def pairing_levenshtein(spark, d):
    """Customers and suppliers whose numbers differ by one edit at most, nearest first."""
    c = ad.read(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "[^0-9]", "").alias("a"))
    s = ad.read(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "[^0-9]", "").alias("b"))
    return relations.fuzzy_nearest(c, s, "a", "b", 1).select("c_custkey", "s_suppkey", F.col("distance").cast("int").alias("distance"))


PAIRS = "p AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part)"


def _pairs(spark, d):
    return ad.read(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))


@query(f"""WITH {PAIRS}, l AS (SELECT p_partkey, a, b, list_distinct(string_split(a, '')) AS cs FROM p),
s AS (SELECT p_partkey, a, b, list_sum(list_transform(cs, lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) AS k FROM l)
SELECT p_partkey, round(k / (length(a) + length(b) - k), 6) AS jaccard, round(k / least(length(a), length(b)), 6) AS overlap FROM s""")
def char_jaccard_pairs(spark, d):
    return _pairs(spark, d).select("p_partkey", F.round(tx.char_jaccard("a", "b"), 6).alias("jaccard"), F.round(tx.overlap_coefficient("a", "b"), 6).alias("overlap"))


@query(f"WITH {PAIRS} SELECT p_partkey, levenshtein(a, b)::INT AS distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS norm FROM p")
def levenshtein_pairs(spark, d):
    return _pairs(spark, d).select("p_partkey", F.levenshtein("a", "b").alias("distance"), F.round(tx.levenshtein_norm("a", "b"), 6).alias("norm"))


@query(f"WITH {PAIRS} SELECT p_partkey, damerau_levenshtein(a, b)::INT AS distance FROM p")
def damerau_pairs(spark, d):
    return _pairs(spark, d).select("p_partkey", stems.damerau_udf()("a", "b").alias("distance"))


@query(f"WITH {PAIRS} SELECT p_partkey, CASE WHEN length(a) = length(b) THEN hamming(a, b) END::INT AS distance FROM p")
def hamming_pairs(spark, d):
    return _pairs(spark, d).select("p_partkey", tx.hamming("a", "b").alias("distance"))


@query(r"SELECT sha256(lower(regexp_replace(split_part(text, chr(10), 1), '[^\p{L}]', '', 'g')) || lower(regexp_replace(text, '[^\p{L}]', '', 'g')) || lower(regexp_replace(source, '[^\p{L}]', '', 'g'))) AS hash_id, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def doc_identity_hash(spark, d):
    c = ad.contexts(spark, d)
    return c.select(tx.identity_hash("title", "abstract", "source").alias("hash_id"), "id").groupBy("hash_id").agg(F.min("id").alias("doc_id"), F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(text, '[.?!]'), lambda x: trim(x) <> '') AS ss FROM documents)
SELECT doc_id, len(ss) AS n_sentences, len(range(1, len(ss) + 1, 7)) AS n_windows FROM s""")
def sentence_windows(spark, d):
    s = ad.read(spark, d, "documents").select("doc_id", F.filter(tx.sentence_parts("text"), lambda x: F.trim(x) != "").alias("ss"))
    return s.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.size(tx.windows_of("ss", 10, 7)).cast("long").alias("n_windows"))


@query("""WITH b AS (SELECT y AS first, y + 2 AS last FROM (SELECT unnest(range(1992, 1997, 2)) AS y)), o AS (SELECT o_orderkey, year(o_orderdate) AS year FROM orders)
SELECT first::INT AS first, last::INT AS last, count(*) AS n FROM b JOIN o ON year BETWEEN first AND last GROUP BY ALL""")
def period_docs(spark, d):
    """Orders by overlapping periods of three years at a step of two; each date is expanded to its periods, so no range join."""
    o = ad.read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("date"))
    return phylo.into_periods(o, 1992, 1998, 3, 2).groupBy("first", "last").agg(F.count("*").alias("n"))


@query("""SELECT user_id, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)::BIGINT AS delta FROM events GROUP BY user_id""")
def events_signed_counts(spark, d):
    """Signed changes summed by key: what the triggers keep."""
    change = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return ad.read(spark, d, "events").groupBy("user_id").agg(F.sum(change).cast("long").alias("delta"))


@query("""WITH n AS (SELECT doc_id, (n_chars > 1000)::INT AS v FROM documents)
SELECT coalesce(l.doc_id, n.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change FROM labels l FULL JOIN n USING (doc_id) WHERE l.quality IS DISTINCT FROM n.v""")
def list_difference(spark, d):
    """What leads from the labels' judgements to one by length: rows put in, and rows changed."""
    old = ad.read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("v"))
    new = ad.read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("v"))
    return relations.changed(old, new, "doc_id", "v")


@query("""SELECT d.doc_id, coalesce(l.quality, 1)::INT AS category FROM documents d LEFT JOIN labels l USING (doc_id)""")
def category_update(spark, d):
    docs = ad.read(spark, d, "documents").select("doc_id", F.lit(1).alias("category"))
    return relations.update_from(docs, ad.read(spark, d, "labels").select("doc_id", F.col("quality").alias("category")), ["doc_id"], "category").select("doc_id", F.col("category").cast("int").alias("category"))


@query("""SELECT d.doc_id, l.doc_id IS NULL AS is_new FROM documents d LEFT JOIN labels l USING (doc_id)""")
def upsert_report(spark, d):
    return relations.upsert_report(ad.read(spark, d, "labels").select("doc_id"), ad.read(spark, d, "documents").select("doc_id"), "doc_id")


# ---- term lists, extraction


@query(f"""WITH {TOK}, s AS (SELECT term, n_docs, row_number() OVER (ORDER BY n_docs DESC, term) AS r FROM df WHERE length(term) > 3)
SELECT term, n_docs, CASE WHEN r <= 9 THEN 'MapTerm' ELSE 'CandidateTerm' END AS list FROM s WHERE r <= 1000""")
def list_build_simple(spark, d):
    """Without votes and stop terms: the nine terms of most documents, then candidates, a thousand in all."""
    counts = occ.document_frequency(ad.document_terms(spark, d)).where(F.length("term") > 3)
    none = spark.createDataFrame([], "term string")
    return terms.build_simple_list(counts, none, none)


@query(f"""WITH {TOK}, l AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL), old AS (SELECT DISTINCT term, 'CandidateTerm' AS l FROM l WHERE lang = 'en' AND n >= 20), new AS (SELECT DISTINCT term, 'MapTerm' AS l FROM l WHERE lang = 'fr' AND n >= 20)
SELECT coalesce(old.term, new.term) AS term, old.l AS old_list, new.l AS new_list FROM old FULL JOIN new ON old.term = new.term""")
def list_diff_by_language(spark, d):
    df = occ.document_frequency(ad.document_terms(spark, d), by=("lang",)).where("n_docs >= 20")
    part = lambda lang, kind: df.where(F.col("lang") == lang).select("term", F.lit(kind).alias("list"))
    return terms.diff(part("en", "CandidateTerm"), part("fr", "MapTerm"))


@query("""WITH p AS (SELECT event_id AS version, 'u' || user_id AS term, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_list, event_type AS new_list FROM events),
v AS (SELECT term, old_list AS list, -1 AS v FROM p WHERE old_list IS NOT NULL UNION ALL SELECT term, new_list, 1 FROM p) SELECT term, list, sum(v)::BIGINT AS vote FROM v GROUP BY ALL""")
def patch_votes(spark, d):
    """The event log as patches of a list: votes for the new kind and against the old."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = ad.read(spark, d, "events").select(F.col("event_id").alias("version"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), F.lag("event_type").over(w).alias("old_list"), F.col("event_type").alias("new_list"))
    return terms.votes(e)


@query("SELECT 'u' || user_id AS term, arg_min(event_type, event_id) AS old_list, arg_max(event_type, event_id) AS new_list, max(event_id) AS version FROM events WHERE event_id > 100 GROUP BY user_id")
def patch_pull(spark, d):
    """Patches since version 100: the last of each term."""
    e = ad.read(spark, d, "events").select(F.col("event_id").alias("version"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), "event_type")
    first = e.where("version > 100").groupBy("term").agg(F.min_by("event_type", "version").alias("old_list"))
    last = terms.pull(e.select("version", "term", F.lit(None).cast("string").alias("old_list"), F.col("event_type").alias("new_list")), 100)
    return last.drop("old_list").join(first, "term").select("term", "old_list", "new_list", "version")


WORDS = r"""list_filter(string_split_regex(lower(text), '[,.:;?!(){}\[\]"''\s]+'), lambda x: x <> '')"""


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), b AS (SELECT item_id, {WORDS} AS fs FROM benchmark), f AS (SELECT DISTINCT item_id, fs FROM b WHERE len(fs) > 0),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), h AS (SELECT doc_id, i, item_id, len(fs) AS n FROM p JOIN f ON ws[i] = fs[1] AND ws[i:i + len(fs) - 1] = fs),
l AS (SELECT doc_id, i, arg_max(item_id, (n, item_id)) AS item_id FROM h GROUP BY doc_id, i)
SELECT doc_id, item_id AS label, count(*) AS n FROM l GROUP BY ALL""")
def dictionary_match(spark, d):
    """The benchmark's items, whole, as forms, found in all documents."""
    b = ad.read(spark, d, "benchmark").select(F.col("item_id").alias("label"), F.array_join(tx.tokens("text"), " ").alias("form")).where("form <> ''")
    return extraction.match_dictionary(ad.read(spark, d, "documents").select("doc_id", "text"), b)


#: Runs of words between stop words and marks, as (doc_id, phrase).
PHRASES = rf"""fr AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[,.:;?!(){{}}\[\]"''\n]+')) AS s FROM documents),
mk AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split_regex(s, '\s+'), lambda w: w <> ''), lambda w: CASE WHEN w IN ({", ".join(f"'{w}'" for w in extraction.STOP_WORDS)}) THEN chr(1) ELSE w END), ' ') AS m FROM fr),
ph AS (SELECT doc_id, trim(unnest(string_split(m, chr(1)))) AS phrase FROM mk)"""


@query(f"""WITH {PHRASES}, p AS (SELECT doc_id, phrase, count(*) AS n FROM ph WHERE phrase <> '' GROUP BY ALL), e AS (SELECT doc_id, phrase, n, len(string_split(phrase, ' ')) AS k, unnest(string_split(phrase, ' ')) AS word FROM p),
s AS (SELECT doc_id, word, sum(k * n) / sum(n) AS s FROM e GROUP BY ALL) SELECT doc_id, phrase, round(sum(s), 6) AS score FROM e JOIN s USING (doc_id, word) GROUP BY ALL""")
def key_phrases(spark, d):
    return extraction.key_phrases(ad.read(spark, d, "documents").select("doc_id", "text"))


@query("""WITH t AS (SELECT doc_id, lang, text, ' ' || lower(text) || ' ' AS x FROM documents), g AS (SELECT doc_id, lang, unnest(list_transform(range(1, greatest(1, length(x) - 2) + 1), lambda i: substring(x, i, 3))) AS gram FROM t WHERE text <> ''),
c AS (SELECT lang, gram, count(*) AS c FROM g SEMI JOIN labels USING (doc_id) GROUP BY ALL), p AS (SELECT lang AS label, gram, ln(c / sum(c) OVER (PARTITION BY lang)) AS weight FROM c),
n AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL), a AS (SELECT doc_id, label, round(sum(c * (weight + 14)), 9) AS s FROM n JOIN p USING (gram) GROUP BY ALL), b AS (SELECT doc_id, max(s) AS s, arg_max(label, (s, 255 - ascii(label), 255 - ascii(label[2]))) AS label FROM a GROUP BY doc_id)
SELECT t.lang, CASE WHEN t.text <> '' THEN CASE WHEN b.s >= 0 THEN b.label ELSE (SELECT min(label) FROM p) END END AS detected, count(*) AS n FROM t LEFT JOIN b USING (doc_id) GROUP BY ALL""")
def lang_detect(spark, d):
    """Each document's language by its runs of characters: the profile is that of all labelled documents."""
    docs = ad.read(spark, d, "documents").select("doc_id", "lang", "text")
    profile = extraction.char_profile(docs.join(ad.read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").where("text <> ''"))
    return extraction.detect_language(docs, profile).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query()
def segment_terms(spark, d):
    """All documents cut into terms by autonomy learnt from all of them."""
    return extraction.segment_terms(ad.read(spark, d, "documents").select("doc_id", "text"), 3)


@query(f"""WITH {TOK}, k AS (SELECT o.doc_id, term, doc_count AS n, quality = 1 AS fav FROM occ o JOIN labels USING (doc_id)), c AS (SELECT term, coalesce(sum(n) FILTER (fav), 0) AS a, coalesce(sum(n) FILTER (NOT fav), 0) AS b FROM k GROUP BY term),
t AS (SELECT sum(a) AS ta, sum(b) AS tb, count(*) AS v FROM c), w AS (SELECT term, ln((a + 1) / (ta + v)) - ln((b + 1) / (tb + v)) AS w FROM c, t)
SELECT doc_id, round(sum(doc_count * w) / sum(doc_count), 9) AS score FROM occ JOIN w USING (term) WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 100""")
def more_like_favourites(spark, d):
    """Documents without a label most like those of quality 1, against those of quality 0."""
    o = ad.document_terms(spark, d).select("doc_id", "term", F.col("doc_count").alias("n"))
    lab = ad.read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("favourite"))
    return extraction.more_like(o, lab, limit=100)


@query(f"""WITH {TOK}, c AS (SELECT term, array_to_string(list_sort(list_filter(string_split(term, ''), lambda x: x <> '')), '') AS k FROM df), g AS (SELECT k, min(term) AS root FROM c GROUP BY k HAVING count(*) > 1) SELECT term, root FROM c JOIN g USING (k)""")
def grouped_forms(spark, d):
    """Terms of the same letters, whatever their order, under the smallest of them: the key of forms is the caller's."""
    t = ad.row_terms(spark, d).select(F.explode("terms").alias("term"))
    return terms.grouped_forms(t, F.array_join(F.array_sort(F.filter(F.split("term", ""), lambda x: x != "")), ""))


# ---- graphs and temporal graphs


def _link_edges(spark, d, n=ad.MAP_TERMS):
    m = similarity.conditional(ad.map_cooc(spark, d, n)).where("value >= 0.9")
    return m.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.col("value").alias("weight"))


@query(f"""WITH RECURSIVE {TOK}, {MAP}, p AS (SELECT y AS a, x AS b FROM cooc JOIN diag da ON da.t = y JOIN diag db ON db.t = x WHERE x <> y AND greatest(n / da.nt, n / db.nt) >= 0.9),
e AS (SELECT a AS s, b AS t FROM p UNION SELECT b, a FROM p), r AS (SELECT DISTINCT s AS node, s AS seen FROM e UNION SELECT r.node, e.t FROM r JOIN e ON e.s = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components(spark, d):
    return graph.components(_link_edges(spark, d))


@query()
def communities(spark, d):
    return graph.communities(_link_edges(spark, d, ad.KERNEL_TERMS))


@query(f"""WITH {TOK}, {KERNEL}, p AS (SELECT y AS a, x AS b FROM cooc JOIN diag da ON da.t = y JOIN diag db ON db.t = x WHERE x <> y AND greatest(n / da.nt, n / db.nt) >= 0.9),
e AS (SELECT a AS s, b AS t FROM p UNION SELECT b, a FROM p), l AS (SELECT s, t FROM e UNION SELECT s, s FROM e), w AS (SELECT s, t, 1 / count(*) OVER (PARTITION BY s) AS w FROM l),
q AS (SELECT u.s AS x, z.t AS y, sum(u.w * v.w * z.w) AS p FROM w u JOIN w v ON v.s = u.t JOIN w z ON z.s = v.t GROUP BY ALL), d AS (SELECT s, count(*) + 1 AS d FROM e GROUP BY s)
SELECT x, y, round(p / (p + d / (SELECT sum(d) FROM d)), 6) AS value FROM q JOIN d ON d.s = y""")
def confluence(spark, d):
    return graph.confluence(_link_edges(spark, d, ad.KERNEL_TERMS), 3).withColumn("value", F.round("value", 6))


@query()
def maximal_cliques(spark, d):
    return graph.maximal_cliques(_link_edges(spark, d, ad.KERNEL_TERMS)).select(F.array_join("clique", " ").alias("clique"))


@query(f"""WITH {TOK}, {MAP}, p AS (SELECT y AS a, x AS b, da.nt AS na, db.nt AS nb, n FROM cooc JOIN diag da ON da.t = y JOIN diag db ON db.t = x WHERE x <> y),
e AS (SELECT CASE WHEN n / nb >= n / na THEN a ELSE b END AS src, CASE WHEN n / nb >= n / na THEN b ELSE a END AS dst, greatest(n / na, n / nb) AS weight FROM p WHERE greatest(n / na, n / nb) >= 0.9),
g AS (SELECT src, dst, weight, length(src) % 3 AS c1, length(dst) % 3 AS c2 FROM e), z AS (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY weight DESC, src, dst) AS r, count(*) OVER (PARTITION BY c1, c2) AS m FROM g)
SELECT src, dst, round(weight, 6) AS weight FROM z WHERE c1 = c2 OR r <= 2 * round(100 * m / (SELECT max(m) FROM z))""")
def bridge_topk(spark, d):
    """Links inside clusters (terms by length modulo three) and the strongest between them."""
    e = _link_edges(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return graph.bridge_links(e, nodes.withColumn("cluster", F.length("node") % 3), 1.0).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem), t AS (SELECT o, [i] AS s FROM b UNION ALL SELECT t.o, list_append(t.s, b.i) FROM t JOIN b ON b.o = t.o AND b.i > t.s[len(t.s)]),
s AS (SELECT s, count(*) AS freq FROM t GROUP BY s HAVING count(*) >= 25)
SELECT array_to_string(s.s, ' ') AS items, freq FROM s WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.freq = s.freq AND len(u.s) = len(s.s) + 1 AND list_has_all(u.s, s.s))""")
def itemsets(spark, d):
    """Suppliers that come together in orders: closed sets of any size in 25 orders at least."""
    b = ad.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return graph.frequent_itemsets(b, "items", 25).select(F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"), "freq")


@query(rf"""WITH {TOK}, n AS (SELECT count(*) AS nd FROM documents), w AS (SELECT term, ln(nd + 1 / tan(pi() / 4)) / ln(n_docs + 1 / tan(pi() / 4)) AS w FROM df, n),
i AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[,.:;?!(){{}}\[\]"''\s]+'), lambda x: x <> ''))) AS term FROM benchmark),
s AS (SELECT a.item_id AS x, b.item_id AS y, sum(w) AS shared FROM i a JOIN i b ON a.term = b.term AND a.item_id < b.item_id JOIN w ON w.term = a.term GROUP BY ALL),
t AS (SELECT item_id, sum(w) AS total FROM i JOIN w USING (term) GROUP BY item_id)
SELECT s.x, s.y, round(shared / (a.total + b.total - shared), 6) AS similarity FROM s JOIN t a ON a.item_id = s.x JOIN t b ON b.item_id = s.y""")
def weighted_log_jaccard(spark, d):
    """Benchmark items as groups of terms, weighted by all documents' counts."""
    df = occ.document_frequency(ad.document_terms(spark, d))
    g = ad.read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(tx.tokens("text")).alias("terms"))
    known = g.select("id", F.explode("terms").alias("term")).join(df, "term", "left_semi").groupBy("id").agg(F.collect_set("term").alias("terms"))
    each = known.select("id", F.explode("terms").alias("term"))
    pairs = each.join(each.select(F.col("id").alias("y"), "term"), "term").where("id < y").select(F.col("id").alias("x"), "y").distinct()
    pairs = pairs.join(known.select(F.col("id").alias("x"), F.col("terms").alias("a")), "x").join(known.select(F.col("id").alias("y"), F.col("terms").alias("b")), "y")
    return phylo.pair_similarity(pairs, df, ad.read(spark, d, "documents").count(), 0.5).select("x", "y", F.round("similarity", 6).alias("similarity"))


def _phylo_groups(spark, d):
    """Cliques of the kernel list's terms in periods of six years: pairs in more than two documents in three of a period."""
    mine = ad.row_terms(spark, d)
    kernel = F.array(*[F.lit(r["term"]) for r in ad.map_terms(spark, d, ad.KERNEL_TERMS).collect()])
    docs = mine.select(F.array_intersect("terms", kernel).alias("terms"), (F.lit(1990) + F.col("doc_id") % 30).cast("int").alias("date")).where(F.size("terms") > 0)
    placed = phylo.into_periods(docs, 1990, 2019, 6, 6)
    least = ad.read(spark, d, "documents").count() // 15
    clusters = phylo.without_nested(phylo.filter_clusters(phylo.clusters_of_periods(placed, kind="cliques", threshold=least, size=3), 1))
    return phylo.groups(clusters)


@query()
def phylo_groups(spark, d):
    return _phylo_groups(spark, d).select("id", "first", "last", F.array_join("terms", " ").alias("terms"), "weight")


@query()
def phylo_branches(spark, d):
    """Groups in branches after raising the threshold of links."""
    g = _phylo_groups(spark, d)
    df = occ.document_frequency(ad.document_terms(spark, d))
    best, kept = phylo.sea_level_rise(g, df, ad.read(spark, d, "documents").count(), step=6, frame=2)
    return phylo.branch_dates(best).withColumn("threshold", F.lit(kept))


# ---- crawled pages, streams, hashes


@query(r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10)) AS text FROM pages""")
def article_paragraphs(spark, d):
    return connectors.article_text(ad.read(spark, d, "pages")).select("page_id", "text")


@query("SELECT user_id, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS total FROM events GROUP BY user_id")
def stream_signed_counts(spark, d):
    """Signed counts kept by a stream over the events' files."""
    live = ingest.live_deltas(ad.stream(spark, d, "events"), "user_id", F.when(F.col("event_type") == "error", -1).otherwise(1))
    return ingest.run_to_files(live).withColumn("total", F.col("total").cast("long"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, d):
    """Counts by hour kept by a stream over the events' files."""
    events = ad.stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_to_files(ingest.windowed_counts(events)).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(f"WITH {TOK} SELECT term, n_docs FROM df")
def stream_term_counts(spark, d):
    """Documents of each term, kept by a stream over the documents' files."""
    return ingest.run_to_files(ingest.live_term_counts(ad.stream(spark, d, "documents")))


@query(f"""WITH {TOK}, {MAP}, g AS (SELECT doc_id, string_agg(term, '' ORDER BY term) AS t FROM items GROUP BY doc_id) SELECT doc_id, sha256(doc_id::VARCHAR || sha256(t)) AS hash FROM g""")
def corpus_row_hashes(spark, d):
    """Documents with their map terms, hashed as the corpus export does."""
    own = ad.document_terms(spark, d).join(F.broadcast(ad.map_terms(spark, d)), "term", "left_semi").select("doc_id", "term")
    return writers.corpus_rows(ad.read(spark, d, "documents").select("doc_id", "source"), own).select("document.doc_id", "hash")


# ---- matrices, series, counters, accounts


def _matrix(spark, d):
    """Quantities ordered by the nation of the customer and of the supplier."""
    o, c, s, li = ad.read(spark, d, "orders"), ad.read(spark, d, "customer"), ad.read(spark, d, "supplier"), ad.read(spark, d, "lineitem")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


MATRIX = "m AS (SELECT c_nationkey AS i, s_nationkey AS j, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


@query(f"WITH {MATRIX} SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 6) AS v FROM m")
def matrix_column_probability(spark, d):
    return matrix.column_probability(_matrix(spark, d)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {MATRIX} SELECT a.i, b.j, round(sum(a.v * b.v), 2) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY ALL")
def matrix_product(spark, d):
    m = _matrix(spark, d)
    return matrix.product(m, m).select("i", "j", F.round("v", 2).alias("v"))


@query(f"WITH {MATRIX}, r AS (SELECT i, sum(v) AS v FROM m WHERE i <> j GROUP BY i), c AS (SELECT j AS i, sum(v) AS w FROM m WHERE i <> j GROUP BY j), g AS (SELECT i, v AS d FROM m WHERE i = j) SELECT i, round(v, 2) AS row_sum, round(w, 2) AS column_sum, round(d, 2) AS diagonal FROM r LEFT JOIN c USING (i) LEFT JOIN g USING (i)")
def matrix_marginals(spark, d):
    m = _matrix(spark, d)
    r, c = matrix.row_sums(m, diagonal=False), matrix.column_sums(m, diagonal=False).select(F.col("j").alias("i"), F.col("v").alias("w"))
    out = r.join(c, "i", "left").join(matrix.diagonal(m).select("i", F.col("v").alias("d")), "i", "left")
    return out.select("i", F.round("v", 2).alias("row_sum"), F.round("w", 2).alias("column_sum"), F.round("d", 2).alias("diagonal"))


@query(f"WITH {MATRIX}, f AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.v, 0) - coalesce(b.v, 0) AS v FROM m a FULL JOIN m b ON a.i = b.j AND a.j = b.i) SELECT i, j, round(v, 2) AS v FROM f WHERE v <> 0")
def matrix_difference(spark, d):
    m = _matrix(spark, d)
    return matrix.elementwise(m, matrix.transpose(m), lambda a, b: a - b).select("i", "j", F.round("v", 2).alias("v"))


@query(f"WITH {MATRIX}, p AS (SELECT a.i, a.j, a.v FROM m a LEFT JOIN m b ON a.i = b.j AND a.j = b.i WHERE a.i <> a.j AND (a.v > coalesce(b.v, -1) OR (a.v = b.v AND a.i < a.j))) SELECT i, j, round(v, 2) AS v FROM p")
def matrix_larger_direction(spark, d):
    return matrix.larger_direction(_matrix(spark, d)).select("i", "j", F.round("v", 2).alias("v"))


@query("""WITH n AS (SELECT date_trunc('day', o_orderdate)::DATE AS day, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS a, lead(n) OVER (ORDER BY day) AS b FROM n) SELECT day, n FROM w WHERE n > a AND n > b""")
def order_peaks(spark, d):
    n = ad.read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return series.local_maxima(n, "day", "n")


@query("""WITH n AS (SELECT o_orderpriority AS p, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY ALL) SELECT p, year, n, coalesce(sum(n) OVER (PARTITION BY p ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM n""")
def running_orders(spark, d):
    n = ad.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return series.running_before(n, "year", "n", "p")


@query("""WITH c AS (SELECT doc_id, source, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS new FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 1), """ + TOK + """
SELECT c.source AS corpus, term, -count(*) AS n FROM c JOIN occ USING (doc_id) WHERE new = 0 GROUP BY ALL""")
def trash_deltas(spark, d):
    """Changes of the counts by corpus and term when toxic documents go to the trash."""
    lab = ad.read(spark, d, "labels").where("toxic = 1 OR quality = 1")
    changes = ad.read(spark, d, "documents").select("doc_id", "source").join(lab, "doc_id").select(F.col("source").alias("corpus"), F.col("doc_id").alias("context_id"), F.lit(1).alias("old"), F.when(F.col("toxic") == 1, 0).otherwise(1).alias("new"))
    return counters.after_changes(changes, ad.document_terms(spark, d).select(F.col("doc_id").alias("context_id"), "term")).withColumn("n", F.col("n").cast("long"))


@query("""WITH p AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations) SELECT conv_id, arg_max(role, turn) AS last_role, count(*) AS turns, sum(n)::BIGINT AS chars FROM p GROUP BY conv_id""")
def conversation_facets(spark, d):
    return ad.read(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"WITH {NODES} SELECT b.id, b.parent_id, b.typename FROM nodes b WHERE b.parent_id = 'r1' OR b.parent_id IN (SELECT id FROM nodes WHERE parent_id = 'r1')")
def tree_two_levels(spark, d):
    return accounts.two_levels(ad.node_tree(spark, d), "r1").select("id", "parent_id", "typename")


@query(f"""WITH {NODES}, c AS (SELECT o.parent_id AS c, count(*) AS n FROM nodes o WHERE typename = 4 GROUP BY 1), n AS (SELECT k.parent_id AS n, sum(c.n) AS n2 FROM c JOIN nodes k ON k.id = c.c GROUP BY 1), r AS (SELECT k.parent_id AS r, sum(n2) AS n3 FROM n JOIN nodes k ON k.id = n.n GROUP BY 1)
SELECT c AS id, n::BIGINT AS total FROM c UNION ALL SELECT n, n2::BIGINT FROM n UNION ALL SELECT r, n3::BIGINT FROM r UNION ALL SELECT 'root', sum(n3)::BIGINT FROM r""")
def tree_counts(spark, d):
    """Orders below every node of the tree."""
    nodes = ad.node_tree(spark, d)
    counts = nodes.where("typename = 4").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    return tree.counts_by_tree(nodes, counts)


@query(f"WITH {TOK}, {MAP} SELECT y AS x, x AS y, round(greatest(n / da.nt, n / db.nt), 6) AS value FROM cooc JOIN diag da ON da.t = y JOIN diag db ON db.t = x WHERE x <> y")
def term_confidence(spark, d):
    return phylo.confidence(ad.map_cooc(spark, d)).select(F.col("y").alias("x"), F.col("x").alias("y"), F.round("value", 6).alias("value"))


@query()
def embedding_components(spark, d):
    """The two directions of greatest variance of the embeddings."""
    e = ad.read(spark, d, "embeddings")
    return matrix.principal_components(e, "embedding", 2).select("vec_id", F.round(F.col("components")[0], 4).alias("a"), F.round(F.col("components")[1], 4).alias("b"))


@query()
def term_communities_graph(spark, d):
    nodes, edges = api.term_graph(ad.map_cooc(spark, d, ad.KERNEL_TERMS), threshold=0.02)
    return edges.select("src", "dst", F.round("weight", 6).alias("weight"))


@query("SELECT lang, year, count(*) AS n FROM (SELECT lang, 1990 + doc_id % 30 AS year FROM documents) GROUP BY ALL")
def facet_by_language_year(spark, d):
    return ad.contexts(spark, d).groupBy("lang", F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


# ---- charts and changes


@query(f"""WITH {TOK}, m AS (SELECT term FROM df ORDER BY n_docs DESC, term LIMIT 400), r AS (SELECT a.term, b.term AS root FROM m a JOIN m b ON a.term = b.term || 's'),
o AS (SELECT DISTINCT doc_id, coalesce(root, occ.term) AS term FROM occ JOIN m USING (term) LEFT JOIN r ON r.term = occ.term) SELECT term, count(*) AS n_docs FROM o GROUP BY term""")
def pie_by_root(spark, d):
    """Documents of the 400 most frequent terms, plural forms under their singular."""
    m = ad.map_terms(spark, d, 400)
    own = ad.document_terms(spark, d).join(F.broadcast(m), "term", "left_semi")
    roots = m.join(m.select(F.concat("term", F.lit("s")).alias("term"), F.col("term").alias("root")), "term")
    return occ.counts_by_root(own, roots)


@query("""WITH y AS (SELECT unnest(range(1980, 2030)) AS date), c AS (SELECT 1990 + doc_id % 30 AS date, count(*) AS n FROM documents GROUP BY 1) SELECT y.date, coalesce(n, 0) AS n FROM y LEFT JOIN c USING (date)""")
def docs_per_date_gapfill(spark, d):
    n = ad.read(spark, d, "documents").groupBy((F.lit(1990) + F.col("doc_id") % 30).cast("long").alias("date")).agg(F.count("*").alias("n"))
    return occ.date_gap_fill(n, "date", "n", 1980, 2029)


@query(f"""WITH {TOK}, t AS (SELECT doc_id, 1990 + doc_id % 30 AS date FROM documents), l AS (SELECT DISTINCT date FROM (SELECT date FROM t ORDER BY date DESC, doc_id LIMIT 50)) SELECT term, count(*) AS n_docs FROM occ JOIN t USING (doc_id) WHERE date IN (SELECT date FROM l) GROUP BY term""")
def recent_term_frequency(spark, d):
    dates = ad.read(spark, d, "documents").select("doc_id", (F.lit(1990) + F.col("doc_id") % 30).alias("date"))
    return occ.recent_frequency(ad.document_terms(spark, d), dates, 50)


@query()
def occurrences_by_stem(spark, d):
    """All documents' occurrences by language and stem."""
    return occ.by_stem(ad.document_terms(spark, d))


@query(f"WITH {TOK}, {MAP} SELECT i.term AS x, d.source AS y, count(*) AS n FROM items i JOIN documents d USING (doc_id) GROUP BY ALL")
def term_source_cooc(spark, d):
    own = ad.document_terms(spark, d).join(F.broadcast(ad.map_terms(spark, d)), "term", "left_semi").select("doc_id", F.col("term").alias("x"))
    return occ.bipartite(own, ad.read(spark, d, "documents").select("doc_id", F.col("source").alias("y")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id FROM labels")
def insert_or_ignore(spark, d):
    return relations.insert_or_ignore(ad.read(spark, d, "labels").select("doc_id"), ad.read(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT d.source, l.toxic AS favourite, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def paired_tables(spark, d):
    docs, lab = ad.read(spark, d, "documents").select("doc_id", "source"), ad.read(spark, d, "labels").select("doc_id", F.col("toxic").alias("favourite"))
    return docs.join(lab, "doc_id").groupBy("source", "favourite").agg(F.count("*").alias("n"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) <= 1")
def used_once(spark, d):
    return relations.used_once(ad.read(spark, d, "orders"), "o_custkey")


@query("SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id")
def user_bounds(spark, d):
    return ad.read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, d):
    return series.sessions(ad.read(spark, d, "events"), "user_id", "ts")


@query(f"""WITH {TOK}, lo AS (SELECT term, count(*) AS n FROM occ WHERE lang = 'en' GROUP BY term HAVING count(*) > 1), t AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'),
sc AS (SELECT lo.term, round(t.n / lo.n * ln(t.n / least(df.n_docs, t.n)), 9) AS tficf FROM lo JOIN df USING (term), t), map AS (SELECT term, tficf FROM sc ORDER BY tficf, term LIMIT 400),
items AS (SELECT doc_id, term FROM occ WHERE term IN (SELECT term FROM map)), cooc AS (SELECT a.term AS x, b.term AS y, count(*) AS n FROM items a JOIN items b ON a.doc_id = b.doc_id GROUP BY ALL), diag AS (SELECT x AS t, n AS nt FROM cooc WHERE x = y),
p AS (SELECT x, y, n / nt AS p FROM cooc JOIN diag ON t = y WHERE x >= y), k AS (SELECT count(*) AS k FROM diag), v AS (SELECT x AS term, (sum(p) - 1) / (any_value(k) - 1) AS v FROM p, k GROUP BY x), h AS (SELECT y AS term, (sum(p) - 1) / (any_value(k) - 1) AS h FROM p, k GROUP BY y),
f AS (SELECT term, tficf, round(v + h, 9) AS i, round(v - h, 9) AS s FROM map JOIN v USING (term) JOIN h USING (term)), a AS (SELECT * FROM f QUALIFY row_number() OVER (ORDER BY tficf, term) <= round(400 * 0.4)),
r AS (SELECT *, row_number() OVER (ORDER BY i DESC, term) AS ri, row_number() OVER (ORDER BY s DESC, term) AS rs FROM a), m AS (SELECT *, ri <= round(40 * 0.4) OR rs <= round(60 * 0.4) AS map FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY map ORDER BY ri, term) AS c FROM m) SELECT term, 1 AS size, CASE WHEN map THEN 'MapTerm' ELSE 'CandidateTerm' END AS list FROM c WHERE map OR c <= round(100 * 0.4)""")
def list_build_quotas(spark, d):
    """A term list with quotas: TF-ICF of the English documents as a corpus against all, inclusion and specificity of the 400 lowest in all documents."""
    rows = ad.row_terms(spark, d)
    total = ad.read(spark, d, "documents").where("lang = 'en'").count()
    scored = similarity.tficf_table(occ.row_frequency(rows.where("lang = 'en'")), occ.row_frequency(rows), total).withColumn("score", F.round("score", 9)).orderBy("score", "term").limit(400)
    m = similarity.inclusion_specificity(occ.list_cooccurrence(rows, scored.select("term")))
    out = scored.join(m, "term").select("term", tx.term_size("term").alias("size"), F.col("score").alias("tficf"), F.round("inclusion", 9).alias("inclusion"), F.round("specificity", 9).alias("specificity"))
    return terms.build_term_list(out, map_size=100, candidates=100, whole=400)


from . import catalogue_more  # noqa: E402,F401 - registers its queries
