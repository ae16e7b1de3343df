"""More registered queries: tables and their changes, joins, lists, texts, matrices, temporal groups, accounts, formats written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem as stems
from ..functions import text as tx
from ..operators import accounts, corpus, counters, graph, matrix, phylo, relations, search, series, similarity, terms, tree
from ..operators import occurrences as occ
from ..sources import readers, services, writers
from . import adapters as ad
from .catalogue import CTX, KERNEL, MAP, MATRIX, NODES, TOK, WORDS, _matrix, query

# ---- tables and their changes

DOCS = "d AS (SELECT doc_id, lang, source, n_chars FROM documents)"


def _docs(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE lang END AS lang, CASE WHEN quality = 1 THEN 'list' ELSE source END AS source, CASE WHEN quality = 1 THEN toxic ELSE n_chars END::BIGINT AS n_chars FROM d LEFT JOIN labels USING (doc_id)")
def upserted_rows(spark, d):
    """Documents of quality 1 put in the place of those with their id."""
    rows = ad.read(spark, d, "labels").where("quality = 1").select("doc_id", F.lit("good").alias("lang"), F.lit("list").alias("source"), F.col("toxic").cast("long").alias("n_chars"))
    return relations.upsert(_docs(spark, d), rows, ["doc_id"])


@query(f"WITH {DOCS} SELECT doc_id, lang, source, n_chars FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_deleted(spark, d):
    return relations.delete_by(_docs(spark, d), ad.read(spark, d, "labels").where("toxic = 1"), ["doc_id"])


@query("SELECT event_id, json_merge_patch(props, '{\"k\": \"new\", \"by\": \"' || event_type || '\"}') ->> '$.k' AS k, json_merge_patch(props, '{\"k\": \"new\", \"by\": \"' || event_type || '\"}') ->> '$.by' AS \"by\" FROM events")
def payload_merge(spark, d):
    """Event payloads with fields put over them: keys of the new object win."""
    e = ad.read(spark, d, "events").select("event_id", "props", F.to_json(F.struct(F.lit("new").alias("k"), F.col("event_type").alias("by"))).alias("new"))
    merged = e.select("event_id", relations.merge_json("props", "new").alias("m"))
    return merged.select("event_id", corpus.json_path("m", "k").alias("k"), corpus.json_path("m", "by").alias("by"))


@query("SELECT DISTINCT a.source AS x, b.lang AS y FROM (SELECT source, doc_id FROM documents) a JOIN (SELECT lang, d.doc_id FROM documents d JOIN labels USING (doc_id)) b USING (doc_id)")
def tables_paired(spark, d):
    a = _docs(spark, d).select(F.col("source").alias("x"), "doc_id")
    b = _docs(spark, d).join(ad.read(spark, d, "labels"), "doc_id").select(F.col("lang").alias("y"), "doc_id")
    return relations.pair_tables(a, b, "doc_id", "x", "y")


@query("SELECT sha256('salt' || c_custkey::VARCHAR || c_name) AS hash, c_custkey FROM customer")
def node_hashes(spark, d):
    return ad.read(spark, d, "customer").select(relations.node_hash("salt", "c_custkey", "c_name").alias("hash"), "c_custkey")


@query(r"SELECT sha256(lower(regexp_replace(c_name, '[^\p{L}]', '', 'g')) || lower(regexp_replace(c_mktsegment, '[^\p{L}]', '', 'g'))) AS hash, count(*) AS n FROM customer GROUP BY 1")
def contact_identity(spark, d):
    return ad.read(spark, d, "customer").groupBy(tx.identity_hash("c_name", "c_mktsegment").alias("hash")).agg(F.count("*").alias("n"))


@query(f"WITH {TOK}, l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'StopTerm' WHEN quality = 1 THEN 'MapTerm' ELSE 'CandidateTerm' END AS list FROM labels) SELECT source AS corpus, list, term, count(*) AS n FROM (SELECT DISTINCT doc_id, source, term FROM tok) JOIN l USING (doc_id) GROUP BY ALL")
def trigger_term_counts(spark, d):
    """Documents by corpus, list kind and term, as the insert trigger counts them."""
    kind = F.when(F.col("toxic") == 1, "StopTerm").when(F.col("quality") == 1, "MapTerm").otherwise("CandidateTerm")
    rows = ad.row_terms(spark, d).join(ad.read(spark, d, "labels").select("doc_id", kind.alias("list")), "doc_id").select(F.col("doc_id").alias("context_id"), "list", F.explode("terms").alias("term"))
    return counters.of_occurrences(rows, _docs(spark, d).select(F.col("doc_id").alias("context_id"), F.col("source").alias("corpus")))


@query("SELECT o_custkey AS user, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def linked_rows(spark, d):
    """Orders linked to customers that are in the table already; others are ignored."""
    links = ad.read(spark, d, "orders").select(F.col("o_custkey").alias("user"), "o_orderkey")
    live = ad.read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user"))
    return links.join(live, "user", "left_semi").groupBy("user").agg(F.count("*").alias("n"))


# ---- scans and filters


@query(f"WITH {NODES} SELECT id, name FROM nodes WHERE parent_id = 'r1' AND typename = 30 ORDER BY id LIMIT 3 OFFSET 1")
def tree_children(spark, d):
    return corpus.children(ad.node_tree(spark, d), "r1", 30, 1, 3).select("id", "name")


@query(f"WITH {NODES} SELECT typename, count(*) AS n, min(id) AS least FROM nodes WHERE typename = 31 GROUP BY typename")
def nodes_of_type(spark, d):
    return corpus.of_type(ad.node_tree(spark, d), 31).groupBy("typename").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_name IS NULL OR c_name = (SELECT max(c_name) FROM customer)")
def rows_owned_by(spark, d):
    users = ad.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    name = users.agg(F.max("username")).first()[0]
    return corpus.owned_by(ad.read(spark, d, "orders").withColumnRenamed("o_custkey", "user_id"), users, name).select("o_orderkey")


@query(f"WITH {CTX} SELECT id, year FROM ctx JOIN links ON id = context_id WHERE category >= 1 AND corpus = 'src3' AND year = 1999 AND (title ILIKE '%er%' OR abstract ILIKE '%er%')")
def corpus_by_year_and_text(spark, d):
    return corpus.matching(corpus.in_corpus(ad.contexts(spark, d), ad.links(spark, d), "src3"), "er", 1999).select("id", "year")


@query(f"WITH {CTX} SELECT id, score FROM ctx ORDER BY score DESC, id LIMIT 25 OFFSET 5")
def page_by_score(spark, d):
    return corpus.page(ad.contexts(spark, d), "ScoreDesc", 5, 25, "id").select("id", "score")


@query(f"WITH {CTX} SELECT id, source FROM ctx ORDER BY source, id LIMIT 25")
def page_by_source(spark, d):
    return corpus.page(ad.contexts(spark, d), "SourceAsc", 0, 25, "id").select("id", "source")


@query(f"WITH {CTX} SELECT id, title FROM ctx ORDER BY title DESC, id LIMIT 30")
def page_by_title(spark, d):
    return corpus.page(ad.contexts(spark, d), "TitleDesc", 0, 30, "id").select("id", "title")


@query("SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::INT AS position FROM events QUALIFY position BETWEEN 10 AND 29")
def paged_by_kind(spark, d):
    """Rows at places 10 to 29 among those of their kind, as the paged scan of a master corpus takes them."""
    return corpus.pages_of(ad.read(spark, d, "events").select("event_id", "event_type"), 10, 20, "event_type", "event_id").select("event_type", "event_id", "position")


@query("SELECT doc_id, coalesce(quality, 0)::INT AS quality, coalesce(role, '') AS role FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, min(role) AS role FROM conversations GROUP BY conv_id) USING (doc_id)")
def rows_with_defaults(spark, d):
    roles = ad.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("role").alias("role"))
    df = _docs(spark, d).join(ad.read(spark, d, "labels"), "doc_id", "left").join(roles, "doc_id", "left").select("doc_id", F.col("quality").cast("int").alias("quality"), "role")
    return corpus.with_defaults(df)


@query(f"WITH {NODES} SELECT id, name FROM nodes WHERE name ILIKE '%an%'")
def tree_name_filter(spark, d):
    return tree.filter_by_name(ad.node_tree(spark, d), "AN").select("id", "name")


# ---- joins


@query("""SELECT r_name, s_name, count(*) AS n FROM region LEFT JOIN (nation LEFT JOIN (supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey) ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey GROUP BY ALL""")
def left_join_nested(spark, d):
    r, n, s, li = (ad.read(spark, d, t) for t in ("region", "nation", "supplier", "lineitem"))
    on = F.col("n_regionkey") == F.col("r_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")
    return relations.nested_left((r, on[0]), (n, on[1]), (s, on[2]), (li, None)).groupBy("r_name", "s_name").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n FROM region, nation, customer WHERE r_regionkey = n_regionkey AND c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name")
def product_with_filter(spark, d):
    r, n, c = (ad.read(spark, d, t) for t in ("region", "nation", "customer"))
    on = (F.col("r_regionkey") == F.col("n_regionkey")) & (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > 0)
    return relations.product_filter(on, r, n, c).groupBy("n_name").agg(F.count("*").alias("n"))


@query("""SELECT region.r_name, p_type, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM region LEFT JOIN nation ON nation.n_regionkey = region.r_regionkey LEFT JOIN customer ON c_nationkey = nation.n_nationkey LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey LEFT JOIN region sr ON sr.r_regionkey = sn.n_regionkey GROUP BY ALL""")
def left_join_chain_9(spark, d):
    r, n, c, o, li, p, s = (ad.read(spark, d, t) for t in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier"))
    sn, sr = n.select(F.col("n_nationkey").alias("k1"), F.col("n_regionkey").alias("k2")), r.select(F.col("r_regionkey").alias("k3"))
    col = F.col
    chain = relations.left_chain(r, (n, col("n_regionkey") == col("r_regionkey")), (c, col("c_nationkey") == col("n_nationkey")), (o, col("o_custkey") == col("c_custkey")), (li, col("l_orderkey") == col("o_orderkey")), (p, col("p_partkey") == col("l_partkey")), (s, col("s_suppkey") == col("l_suppkey")), (sn, col("k1") == col("s_nationkey")), (sr, col("k3") == col("k2")))
    return chain.groupBy("r_name", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000 WHERE c_custkey IS NULL OR c_mktsegment = 'BUILDING'")
def lateral_restrict(spark, d):
    c = ad.read(spark, d, "customer").where("c_acctbal > 5000")
    out = relations.optional_restrict(ad.read(spark, d, "orders"), c, F.col("c_custkey") == F.col("o_custkey"), F.col("c_mktsegment") == "BUILDING", "c_custkey")
    return out.select("o_orderkey", "c_name")


@query(f"""WITH RECURSIVE {NODES}, o AS (SELECT id AS start FROM nodes WHERE typename = 31), u AS (SELECT start, start AS id, 0 AS depth FROM o UNION ALL SELECT start, n.parent_id, depth + 1 FROM u JOIN nodes n ON n.id = u.id WHERE n.parent_id IS NOT NULL)
SELECT start AS id, id AS ancestor, depth::INT AS depth FROM u""")
def tree_ancestors(spark, d):
    nodes = ad.node_tree(spark, d)
    return tree.ancestors(nodes, nodes.where("typename = 31").select("id"))


@query(f"WITH {NODES} SELECT c.id, CASE WHEN c.typename = 30 THEN c.id ELSE c.parent_id END AS closest FROM nodes c WHERE c.typename IN (30, 31)")
def tree_closest_with_self(spark, d):
    nodes = ad.node_tree(spark, d)
    return tree.closest_of_type(nodes, nodes.where("typename IN (30, 31)").select("id"), 30, including_self=True)


@query(f"""WITH {NODES}, s AS (SELECT 'f' || id AS folder, id AS node FROM nodes WHERE typename = 30 AND parent_id <> 'r0')
SELECT node AS id, folder AS parent_id, 0 AS depth FROM s UNION ALL SELECT c.id, c.parent_id, 1 FROM nodes c JOIN s ON c.parent_id = s.node""")
def tree_shared(spark, d):
    """Nations shared in folders of their own, with their customers."""
    nodes = ad.node_tree(spark, d)
    links = nodes.where("typename = 30 AND parent_id <> 'r0'").select(F.concat(F.lit("f"), "id").alias("folder"), F.col("id").alias("node"))
    return tree.shared_trees(links, nodes, first_level=True)


@query(f"WITH {NODES} SELECT c.id, 2 AS depth, c.typename FROM nodes c JOIN nodes n ON c.parent_id = n.id WHERE n.parent_id = 'r2' AND c.typename = 31")
def tree_below_of_types(spark, d):
    nodes = ad.node_tree(spark, d)
    return accounts.below_of_types(nodes, nodes.where("id = 'r2'").select("id"), [31], [30])


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents) SELECT 'text' AS field, term, count(*) AS n_docs, sum(tf)::BIGINT AS hits, max(length)::INT AS longest FROM (SELECT doc_id, term, count(*) AS tf, any_value(l) AS length FROM (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM w) GROUP BY doc_id, term) GROUP BY term")
def inverted_index_totals(spark, d):
    """The index that ranked search reads, added up by term."""
    i = search.inverted_index(ad.read(spark, d, "documents"), ["text"])
    return i.groupBy("field", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("hits"), F.max("length").alias("longest"))


@query(f"WITH {TOK}, {MAP}, m AS (SELECT term FROM map ORDER BY term) SELECT term FROM m WHERE term IN (SELECT term FROM occ WHERE doc_id = 7)")
def terms_of_one_document(spark, d):
    """Terms of the map list that a document holds."""
    own = ad.row_terms(spark, d).where("doc_id = 7").first()
    asked = ad.map_terms(spark, d).select("term", F.array("term").alias("stems"))
    return search.terms_in_document(asked, list(own["terms"])).select("term")


# ---- terms and occurrences


@query(f"WITH {TOK}, {MAP} SELECT term, list_sort(list(doc_id)) AS docs FROM items GROUP BY term")
def term_contexts(spark, d):
    """The documents of each term of the map list, turned round from the terms of each document."""
    held = F.broadcast(ad.map_terms(spark, d))
    own = ad.row_terms(spark, d).select("doc_id", F.explode("terms").alias("term")).join(held, "term", "left_semi").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    return occ.inverted(own, "doc_id", "terms").select(F.col("terms").alias("term"), F.col("doc_id").alias("docs"))


@query(f"WITH {TOK}, r AS (SELECT a.term, b.term AS root FROM df a JOIN df b ON a.term = b.term || 's') SELECT doc_id, coalesce(root, occ.term) AS term, sum(doc_count)::BIGINT AS doc_count FROM occ LEFT JOIN r ON r.term = occ.term GROUP BY ALL")
def synonyms_merged(spark, d):
    """Occurrences under singular forms, where the corpus has them."""
    o = ad.document_terms(spark, d)
    t = o.select("term").distinct()
    roots = t.join(t.select(F.concat("term", F.lit("s")).alias("term"), F.col("term").alias("root")), "term")
    return occ.merge_synonyms(o, roots)


@query(f"WITH {TOK} SELECT term, n_docs FROM df WHERE n_docs = (SELECT max(n_docs) FROM df)")
def term_argmax(spark, d):
    return occ.argmax(occ.row_frequency(ad.row_terms(spark, d)), "term", "n_docs")


@query("SELECT round(avg(length(text)), 6) AS mean FROM documents")
def mean_document_size(spark, d):
    return occ.mean_size(ad.read(spark, d, "documents"), "text").select(F.round("mean", 6).alias("mean"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return series.group_counts(ad.read(spark, d, "events"), "event_type")


@query("WITH g AS (SELECT c_mktsegment, c_custkey, c_acctbal AS v FROM customer), m AS (SELECT c_mktsegment, max(v) AS v FROM g GROUP BY ALL HAVING max(v) > 0) SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM g JOIN m USING (c_mktsegment, v) GROUP BY c_mktsegment")
def greatest_by_group(spark, d):
    return series.positive_argmax(ad.read(spark, d, "customer"), "c_mktsegment", "c_custkey", "c_acctbal")


@query(f"WITH {TOK}, p AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY ALL) SELECT lang, term, n AS n_docs FROM p QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 50")
def top_terms_by_language(spark, d):
    return occ.top_terms(occ.row_frequency(ad.row_terms(spark, d), ("lang",)), 50, ("lang",)).select("lang", "term", "n_docs")


@query(f"WITH {TOK} SELECT lang, doc_id, term, doc_count FROM occ JOIN (SELECT lang, term FROM occ GROUP BY ALL HAVING count(*) BETWEEN 3 AND 9) USING (lang, term)")
def occurrences_within_bounds(spark, d):
    """Occurrences of the terms that three to nine documents of a language hold."""
    return occ.by_frequency(ad.document_terms(spark, d), 3, 9, by=("lang",)).select("lang", "doc_id", "term", "doc_count")


@query("SELECT coalesce(l, event_type) AS label, count(*) AS n FROM (SELECT unnest([event_type, 'other']) AS event_type FROM events) LEFT JOIN (VALUES ('view', 'seen'), ('purchase', 'bought')) AS m(event_type, l) USING (event_type) GROUP BY 1")
def counts_by_mapped_name(spark, d):
    """Rows by the name of each of their values, or the value itself."""
    names = spark.createDataFrame([("view", "seen"), ("purchase", "bought")], "kind string, label string")
    rows = ad.read(spark, d, "events").select(F.array("event_type", F.lit("other")).alias("kinds"))
    return occ.mapped_counts(rows, "kinds", names, "kind", "label")


# ---- lists of terms

STATE = f"""{TOK}, top AS (SELECT term, n_docs, row_number() OVER (ORDER BY n_docs DESC, term) AS r FROM df QUALIFY r <= 600), st AS (SELECT t.term, CASE t.r % 3 WHEN 0 THEN 'MapTerm' WHEN 1 THEN 'CandidateTerm' ELSE 'StopTerm' END AS list, p.term AS root FROM top t LEFT JOIN top p ON t.term = p.term || 's')"""


def _state(spark, d) -> DataFrame:
    """A list of the 600 most frequent terms: kinds by rank, plurals under their singular."""
    top = occ.top_terms(occ.row_frequency(ad.row_terms(spark, d)), 600).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n_docs"), "term")))  # 600 rows
    single = top.select(F.concat("term", F.lit("s")).alias("term"), F.col("term").alias("root"))
    kind = F.when(F.col("r") % 3 == 0, "MapTerm").when(F.col("r") % 3 == 1, "CandidateTerm").otherwise("StopTerm")
    s = top.join(single, "term", "left").select("term", tx.term_size("term").alias("size"), kind.alias("list"), "root", F.col("root").alias("parent"))
    below = s.where("root IS NOT NULL").groupBy(F.col("root").alias("term")).agg(F.array_sort(F.collect_set("term")).alias("children"))
    return s.join(below, "term", "left")


@query(f"WITH {STATE} SELECT s.term, coalesce(r.list, s.list) AS effective FROM st s LEFT JOIN st r ON r.term = s.root")
def list_with_roots(spark, d):
    return terms.with_root_list(_state(spark, d)).select("term", "effective")


@query(f"WITH {STATE} SELECT s.term FROM st s LEFT JOIN st r ON r.term = s.root WHERE coalesce(r.list, s.list) IN ('MapTerm', 'CandidateTerm')")
def list_of_kinds(spark, d):
    return terms.of_lists(_state(spark, d), ["MapTerm", "CandidateTerm"]).select("term")


@query(f"WITH {STATE} SELECT coalesce(root, term) AS root, array_to_string(list_sort(list_distinct(list(term))), ' ') AS members FROM st GROUP BY 1")
def list_roots_with_members(spark, d):
    return terms.roots_with_members(_state(spark, d)).select("root", F.array_join("members", " ").alias("members"))


@query(f"""WITH {STATE}, c AS (SELECT root AS term, 'x' AS down FROM st), p AS (SELECT term, list AS old FROM st WHERE term LIKE 'a%'), o AS (SELECT st.term FROM st JOIN p USING (term) WHERE st.list = p.old)
SELECT s.term, CASE WHEN s.term IN (SELECT term FROM o) OR s.root IN (SELECT term FROM o) THEN 'StopTerm' ELSE s.list END AS list FROM st s""")
def list_patched(spark, d):
    """Terms that begin with a are moved to the stop list; their plurals go with them."""
    s = _state(spark, d)
    patches = s.where("term LIKE 'a%'").select(F.lit(1).alias("version"), "term", F.col("list").alias("old_list"), F.lit("StopTerm").alias("new_list"))
    return terms.apply_patches(s, patches).select("term", "list")


@query("""WITH p AS (SELECT event_id AS version, 'u' || user_id AS term, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_list, event_type AS new_list FROM events),
v AS (SELECT term, list, sum(v) AS vote FROM (SELECT term, old_list AS list, -1 AS v FROM p WHERE old_list IS NOT NULL UNION ALL SELECT term, new_list, 1 FROM p) GROUP BY ALL) SELECT term, max(list) AS list FROM v WHERE vote > 0 GROUP BY term""")
def list_elected(spark, d):
    """The kind that each user's last events elect: votes of a chain add up to its end."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = ad.read(spark, d, "events").select(F.col("event_id").alias("version"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), F.lag("event_type").over(w).alias("old_list"), F.col("event_type").alias("new_list"))
    return terms.elected(terms.votes(e))


@query("SELECT 'u' || user_id AS term, arg_max(event_type, event_id) AS list, max(event_id) AS version FROM events GROUP BY user_id")
def list_states_merged(spark, d):
    e = ad.read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), F.col("event_type").alias("list"), F.col("event_id").alias("version"))
    return terms.merge_states(e)


@query(f"WITH {STATE}, o AS (SELECT DISTINCT coalesce(root, st.term) AS term, doc_id FROM st JOIN occ USING (term)), h AS (SELECT DISTINCT coalesce(root, term) AS term FROM st WHERE list = 'MapTerm' AND term LIKE '%e%') SELECT st.term, count(doc_id) AS score FROM st JOIN h USING (term) LEFT JOIN o USING (term) GROUP BY st.term ORDER BY score DESC, st.term LIMIT 40 OFFSET 3")
def term_table_page(spark, d):
    """A page of the term table: map terms that hold an e, by the documents of all their forms."""
    held = ad.row_terms(spark, d).select("doc_id", F.explode("terms").alias("term")).groupBy("term").agg(F.collect_set("doc_id").alias("occurrences"))
    page, _ = terms.search_terms(_state(spark, d).join(held, "term", "left"), kind="MapTerm", part="E", order="ScoreDesc", offset=3, limit=40)
    return page.select("term", "score")


@query(f"WITH {STATE} SELECT CASE list WHEN 'MapTerm' THEN 'map' WHEN 'StopTerm' THEN 'stop' ELSE 'main' END AS status, s.term AS label, coalesce((SELECT string_agg(c.term, '|&|' ORDER BY c.term) FROM st c WHERE c.root = s.term), '') AS forms FROM st s WHERE root IS NULL")
def term_list_export(spark, d):
    return writers.term_list_rows(_state(spark, d))


# ---- texts


@query("SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS size FROM documents")
def term_sizes(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", tx.term_size("text").cast("long").alias("size"))


@query(r"SELECT doc_id, sha256(text) AS hash, sha256(array_to_string(list_sort(list_transform(string_split(source || ' ' || lang, ' '), lambda x: sha256(x))), '')) AS set_hash FROM documents")
def text_hashes(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", tx.text_hash("text").alias("hash"), tx.set_hash(F.split(F.concat_ws(" ", "source", "lang"), " ")).alias("set_hash"))


@query(r"SELECT doc_id, sha256(replace(replace(replace(replace(text, '’', ''''), chr(13), ' '), chr(9), ' '), ';', '.')) AS hash FROM documents")
def texts_cleaned(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", F.sha2(tx.clean_bytes("text"), 256).alias("hash"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(https?://|www\.)\S+', '', 'g'), '[0-9]+(-[0-9]+)+', '', 'g'), '\s+', ' ', 'g'))) AS hash FROM documents")
def texts_for_tagging(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", F.sha2(tx.clean_for_tagging("text"), 256).alias("hash"))


@query(r"SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: length(w) < 25), ' ')) AS hash FROM documents")
def long_words_dropped(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", F.sha2(tx.drop_long_words("text"), 256).alias("hash"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS n FROM documents""")
def paragraph_counts(spark, d):
    return ad.read(spark, d, "documents").select("doc_id", F.size(tx.paragraphs("text")).cast("long").alias("n"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents) SELECT doc_id, ((len(ws) + 9) // 10)::BIGINT AS blocks, greatest(0, len(ws) - 2)::BIGINT AS runs FROM w")
def word_blocks(spark, d):
    """Blocks of ten words, and runs of three."""
    w = ad.read(spark, d, "documents").select("doc_id", tx.tokens("text").alias("w"))
    return w.select("doc_id", F.size(tx.blocks_of("w", 10)).cast("long").alias("blocks"), F.size(tx.ngrams_of("w", 3)).cast("long").alias("runs"))


@query("SELECT p_partkey, substring(p_name, 1, 255) AS clip, trim(p_name) AS term, (length(trim(p_name)) - length(replace(trim(p_name), ' ', '')) + 1)::INT AS n FROM part")
def part_terms(spark, d):
    t = tx.text_and_count("p_name")
    return ad.read(spark, d, "part").select("p_partkey", tx.clip_term("p_name").alias("clip"), t["term"].alias("term"), t["n"].cast("int").alias("n"))


@query(r"SELECT p_partkey, array_to_string(list_transform(range(1, greatest(0, length(p_type) - 2) + 1), lambda i: substring(p_type, i, 3)), '|') AS windows FROM part")
def char_windows_of_types(spark, d):
    return ad.read(spark, d, "part").select("p_partkey", F.array_join(tx.char_windows("p_type", 2), "|").alias("windows"))


@query(r"SELECT p_partkey, array_to_string(regexp_extract_all(p_name || ', ' || p_type || '.', '([[:punct:]]+|[^[:punct:]]+)'), '|') AS parts FROM part")
def punctuation_parts(spark, d):
    return ad.read(spark, d, "part").select("p_partkey", F.array_join(tx.split_punctuation(F.concat("p_name", F.lit(", "), "p_type", F.lit("."))), "|").alias("parts"))


@query(r"SELECT o_orderkey, year(o_orderdate)::INT AS y, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m, (date_diff('day', DATE '0000-01-01', o_orderdate::DATE) // 7)::INT AS w, date_diff('day', DATE '0000-01-01', o_orderdate::DATE)::INT AS d FROM orders")
def date_units(spark, d):
    return ad.read(spark, d, "orders").select("o_orderkey", *(series.time_unit("o_orderdate", u).cast("int").alias(n) for u, n in (("year", "y"), ("month", "m"), ("week", "w"), ("day", "d"))))


# ---- matrices and similarities


@query(f"WITH {MATRIX} SELECT i, j, round(v / d, 6) AS v FROM m JOIN (SELECT i AS j, v AS d FROM m WHERE i = j) USING (j)")
def matrix_over_diagonal(spark, d):
    return matrix.divide_by_diagonal(_matrix(spark, d)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {MATRIX} SELECT j AS i, i AS j, CASE WHEN v > 1000 THEN round(v, 2) ELSE 0 END AS v FROM m")
def matrix_threshold(spark, d):
    """Cells above a threshold, transposed as the dense kernel has it."""
    return matrix.keep_above(_matrix(spark, d), 1000.0, transposed=True).select("i", "j", F.round("v", 2).alias("v"))


@query(f"WITH {MATRIX} SELECT round(sum(v), 2) AS v FROM m")
def matrix_total(spark, d):
    return matrix.total(_matrix(spark, d)).select(F.round("v", 2).alias("v"))


@query(f"WITH {MATRIX} SELECT i, j, round(v, 2) AS v FROM m WHERE i <> j AND i < 25 UNION ALL SELECT i, j, round(v - 1, 2) FROM m WHERE i = j AND v <> 1 UNION ALL SELECT n_nationkey, n_nationkey, -1 FROM nation WHERE n_nationkey NOT IN (SELECT i FROM m WHERE i = j)")
def matrix_less_identity(spark, d):
    eye = matrix.identity(spark, 25).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v")
    return matrix.elementwise(_matrix(spark, d), eye, lambda a, b: a - b).select("i", "j", F.round("v", 2).alias("v"))


@query(f"WITH {TOK}, {MAP}, ix AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k FROM map) SELECT a.k::INT AS i, b.k::INT AS j, n AS v FROM cooc JOIN ix a ON a.term = x JOIN ix b ON b.term = y")
def cooc_by_index(spark, d):
    index = matrix.indexed_terms(ad.map_terms(spark, d))
    return matrix.to_indices(ad.map_cooc(spark, d), index).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "v")


@query("SELECT c_custkey, floor(c_acctbal * 10) / 10 AS v FROM customer")
def balances_truncated(spark, d):
    return ad.read(spark, d, "customer").select("c_custkey", matrix.truncated("c_acctbal", 1).alias("v"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) FROM customer), 9) AS v, round(CASE WHEN c_acctbal > 0 THEN 1 + ln(100000 * c_acctbal) ELSE 0 END, 9) AS w FROM customer")
def scores_normalised(spark, d):
    c = ad.read(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"), similarity.normalise_local("c_acctbal").alias("w"))
    return similarity.normalise_global(c, "v").select("c_custkey", F.round("v", 9).alias("v"), F.round("w", 9).alias("w"))


@query(f"WITH {TOK}, {MAP}, p AS (SELECT x, y, n / nt AS value FROM off JOIN diag ON t = y), lim AS (SELECT max(m) AS v FROM (SELECT min(value) AS m FROM p GROUP BY x)) SELECT x, y, round(value, 6) AS value FROM p, lim WHERE value > v")
def cells_above_maxmini(spark, d):
    m = ad.map_cooc(spark, d)
    p = similarity.mirrored(m).join(similarity.diagonal(m).withColumnRenamed("t", "y"), "y").select("x", "y", (F.col("n") / F.col("nt")).alias("value"))
    return similarity.maxmini(p).withColumn("value", F.round("value", 6))


@query(f"WITH {TOK}, {MAP}, p AS (SELECT x, y, n / nt AS value FROM off JOIN diag ON t = y) SELECT a.x, a.y, round(a.value, 6) AS value FROM p a JOIN p b ON a.x = b.y AND a.y = b.x WHERE a.value > b.value OR (a.value = b.value AND a.x < a.y)")
def cells_symmetrised(spark, d):
    m = ad.map_cooc(spark, d)
    p = similarity.mirrored(m).join(similarity.diagonal(m).withColumnRenamed("t", "y"), "y").select("x", "y", (F.col("n") / F.col("nt")).alias("value"))
    return similarity.symmetrised(p).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem), a AS (SELECT 'o' || src AS src, 's' || dst AS dst FROM e), b AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM a UNION ALL SELECT dst FROM a) GROUP BY node) SELECT node, degree FROM b WHERE degree >= 2""")
def graph_degrees(spark, d):
    return graph.degrees(_order_edges(spark, d)).where("degree >= 2")


def _order_edges(spark, d):
    e = ad.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return e.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


@query("""WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem), b AS (SELECT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node HAVING count(*) >= 3) SELECT src, dst FROM e WHERE src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b)""")
def graph_degree_filter(spark, d):
    return graph.degree_filter(_order_edges(spark, d), 3)


# ---- temporal groups: benchmark items as groups of terms, by periods

GROUPS = f"""w AS (SELECT item_id, list_sort(list_distinct({WORDS})) AS terms FROM benchmark), g AS (SELECT item_id::VARCHAR AS id, (1990 + item_id % 5)::INT AS first, terms, 'b' || item_id % 3 AS branch FROM w WHERE len(terms) > 0), e AS (SELECT id, first, branch, unnest(terms) AS term FROM g)"""


def _groups(spark, d) -> DataFrame:
    g = ad.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), (F.lit(1990) + F.col("item_id") % 5).cast("int").alias("first"), F.array_sort(F.array_distinct(tx.tokens("text"))).alias("terms"), F.concat(F.lit("b"), (F.col("item_id") % 3).cast("string")).alias("branch"))
    return g.where(F.size("terms") > 0).withColumn("last", F.col("first"))


@query(f"WITH {GROUPS}, s AS (SELECT term, min(first) AS lo, max(first) AS hi FROM e GROUP BY term) SELECT id, term, CASE WHEN first = lo AND first = hi THEN 0 WHEN first = lo THEN 1 WHEN first = hi THEN 2 ELSE 3 END AS dynamic FROM e JOIN s USING (term)")
def phylo_term_dynamics(spark, d):
    return phylo.term_dynamics(_groups(spark, d))


@query(f"WITH {GROUPS} SELECT branch, min(first) AS birth, max(first) - min(first) AS age, count(DISTINCT first) AS size, count(*) AS n_groups FROM g GROUP BY branch")
def phylo_branch_dates(spark, d):
    return phylo.branch_dates(_groups(spark, d))


@query(f"WITH {GROUPS}, tf AS (SELECT branch, term, count(*) AS tf FROM e GROUP BY ALL), dft AS (SELECT term, count(*) AS df FROM tf GROUP BY term), t AS (SELECT count(DISTINCT branch) AS total FROM g), s AS (SELECT branch, term, round(tf * ln(total / df + 1), 9) AS s FROM tf JOIN dft USING (term), t), r AS (SELECT branch, term, row_number() OVER (PARTITION BY branch ORDER BY s DESC, term) AS r FROM s) SELECT branch, string_agg(term, ' ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY branch")
def phylo_branch_labels(spark, d):
    return phylo.branch_labels(_groups(spark, d))


@query(f"WITH {GROUPS} SELECT branch, count(*) AS n FROM g GROUP BY branch HAVING count(*) >= 2")
def phylo_large_branches(spark, d):
    return phylo.large_branches(_groups(spark, d), 2).groupBy("branch").agg(F.count("*").alias("n"))


@query(f"WITH {GROUPS} SELECT a.id AS src, b.id AS dst, (b.first - a.first)::INT AS gap, count(*) AS shared FROM e a JOIN e b ON a.term = b.term AND b.first > a.first AND b.first <= a.first + 2 GROUP BY ALL HAVING count(*) >= 3")
def phylo_candidates(spark, d):
    """Pairs of groups of near periods that share three terms."""
    return phylo.candidate_links(_groups(spark, d), 2, least_shared=3).select("src", "dst", "gap", "shared")


@query(f"WITH {GROUPS}, l AS (SELECT a.id AS src, b.id AS dst, count(*) / 100 AS similarity FROM e a JOIN e b ON a.term = b.term AND a.id <> b.id AND abs(a.first - b.first) = 1 GROUP BY ALL) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(similarity) AS similarity FROM l GROUP BY ALL")
def phylo_pointers_merged(spark, d):
    g = _groups(spark, d).select("id", "first", F.explode("terms").alias("term"))
    o = g.select(F.col("id").alias("dst"), F.col("first").alias("f2"), "term")
    links = g.join(o, "term").where((F.col("id") != F.col("dst")) & (F.abs(F.col("first") - F.col("f2")) == 1)).groupBy(F.col("id").alias("src"), "dst").agg((F.count("*") / 100).alias("similarity"))
    return phylo.merged_pointers(links)


@query("""WITH l AS (SELECT DISTINCT o_custkey AS parent, l_suppkey AS mid, l_partkey AS child FROM orders JOIN lineitem ON l_orderkey = o_orderkey), d AS (SELECT DISTINCT parent, mid FROM l), u AS (SELECT DISTINCT mid, child % 50 AS child FROM l)
SELECT 'c' || parent AS parent, 'p' || child AS child, count(*) AS n FROM d JOIN u USING (mid) GROUP BY ALL HAVING count(*) > 1""")
def graph_diamonds(spark, d):
    """Customers and groups of parts with two suppliers or more between them."""
    j = ad.read(spark, d, "lineitem").join(ad.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias(c)
    j = j.select(F.col("o_custkey").alias("parent"), F.col("l_suppkey").alias("mid"), (F.col("l_partkey") % 50).alias("child"))
    return phylo.diamond_counts(j, j).select(name("c", "parent"), name("p", "child"), "n")


@query("SELECT (1992 + 2 * ((year(o_orderdate) - 1992) // 2))::INT AS first, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1992 AND 1997 GROUP BY 1")
def period_docs_consuming(spark, d):
    """Orders by periods of two years, each in the first that takes it."""
    o = ad.read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("date"))
    return phylo.into_periods(o, 1992, 1997, 2, 2, consuming=True).groupBy("first").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT o_custkey, year(o_orderdate)::INT AS first, count(*) AS support FROM orders GROUP BY ALL), t AS (SELECT *, max(support) OVER (PARTITION BY first) AS top FROM c) SELECT first, o_custkey, support FROM t WHERE support >= least(6, top)")
def phylo_cluster_filter(spark, d):
    """Customers by year with six orders or more; a year without any keeps its greatest."""
    c = ad.read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("first"), "o_custkey").agg(F.count("*").alias("support")).withColumn("last", F.col("first"))
    return phylo.filter_clusters(c, 6).select("first", "o_custkey", "support")


# ---- accounts: customers as users, their orders as nodes

USERS = "users AS (SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@host' AS mail FROM customer), own AS (SELECT c_custkey * 10 AS id, CASE WHEN c_custkey % 3 = 0 THEN 22 ELSE 1 END AS typename, c_custkey AS user_id, c_name AS name FROM customer)"


def _users(spark, d):
    return ad.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat(F.lower("c_name"), F.lit("@host")).alias("mail"))


def _own(spark, d):
    c = ad.read(spark, d, "customer")
    return c.select((F.col("c_custkey") * 10).alias("id"), F.when(F.col("c_custkey") % 3 == 0, 22).otherwise(1).alias("typename"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("hyperdata"))


@query(f"WITH {USERS} SELECT id, mail FROM users WHERE username = (SELECT min(username) FROM users)")
def user_by_name(spark, d):
    u = _users(spark, d)
    return accounts.users_by(u, username=u.agg(F.min("username")).first()[0]).select("id", "mail")


@query(f"WITH {USERS} SELECT u.id, o.id AS node_id, c_mktsegment AS hyperdata FROM users u LEFT JOIN own o ON o.user_id = u.id AND typename = 1 LEFT JOIN customer c ON c.c_custkey = o.user_id")
def users_with_payload(spark, d):
    return accounts.with_payload(_users(spark, d), _own(spark, d)).select("id", "node_id", "hyperdata")


@query(f"WITH {USERS} SELECT id, CASE WHEN id = 10 THEN 'renamed' ELSE name END AS name, CASE WHEN id = 20 THEN 7 ELSE user_id END AS parent_id FROM own")
def nodes_renamed_and_moved(spark, d):
    n = _own(spark, d).withColumn("parent_id", F.col("user_id"))
    return accounts.move(accounts.rename(n, 10, "renamed"), 20, 7).select("id", "name", "parent_id")


@query(f"WITH {USERS} SELECT id, CASE WHEN typename = 22 THEN upper(name) ELSE c_mktsegment END AS hyperdata FROM own JOIN customer ON c_custkey = user_id")
def nodes_of_type_updated(spark, d):
    return accounts.update_type(_own(spark, d), 22, F.upper("name")).select("id", "hyperdata")


@query(f"WITH {USERS} SELECT id, CASE WHEN id % 2 = 0 THEN 'new' || id ELSE mail END AS mail, username FROM users")
def users_updated(spark, d):
    u = _users(spark, d)
    new = u.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("id").cast("string"))).alias("mail"))
    return accounts.update_given(u, new, "id")


@query(f"WITH {USERS}, l AS (SELECT c_custkey * 10 AS folder, o_orderkey AS node FROM orders JOIN customer ON c_custkey = o_custkey) SELECT folder AS id, count(DISTINCT node) AS n FROM l JOIN own ON own.id = folder WHERE typename = 22 GROUP BY folder")
def public_folders(spark, d):
    links = ad.read(spark, d, "orders").select((F.col("o_custkey") * 10).alias("folder"), F.col("o_orderkey").alias("node"))
    return accounts.public_folders(_own(spark, d), links).select("id", F.size("shared").cast("long").alias("n"))


@query(f"WITH {USERS}, l AS (SELECT o_custkey * 10 AS folder, o_orderkey AS node FROM orders) SELECT folder, username, count(*) AS n FROM l JOIN own ON own.id = folder JOIN users ON users.id = user_id GROUP BY ALL")
def team_members(spark, d):
    links = ad.read(spark, d, "orders").select((F.col("o_custkey") * 10).alias("folder"), F.col("o_orderkey").alias("node"))
    return accounts.team(links, _own(spark, d), _users(spark, d)).groupBy("folder", "username").agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT parent_id, min(id) AS id FROM nodes WHERE typename = 4 GROUP BY parent_id")
def first_of_type(spark, d):
    return accounts.first_of_type(ad.node_tree(spark, d), 4).select("parent_id", "id")


# ---- formats: written by the sinks, read back by the readers


def _folder(spark, name: str) -> str:
    """A new folder in that of the checkpoints, which driver and executors share."""
    graph.checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


FLAT = r"f AS (SELECT doc_id, 'Title ' || doc_id AS title, source, (1990 + doc_id % 30)::INT AS year, (1 + doc_id % 12)::INT AS month, (1 + doc_id % 28)::INT AS day, trim(regexp_replace(text, '\s+', ' ', 'g')) AS abstract FROM documents), g AS (SELECT * FROM f WHERE abstract <> '')"


def _flat(spark, d) -> DataFrame:
    f = ad.read(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), "source", (F.lit(1990) + F.col("doc_id") % 30).cast("int").alias("publication_year"), (F.lit(1) + F.col("doc_id") % 12).cast("int").alias("publication_month"),
        (F.lit(1) + F.col("doc_id") % 28).cast("int").alias("publication_day"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("abstract"), F.lit("A. Author, B. Writer").alias("authors"),
    )
    return f.where("abstract <> ''")


@query(f"WITH {FLAT} SELECT title, source, year AS publication_year, month AS publication_month, day AS publication_day, lpad(year::VARCHAR, 4, '0') || '-' || lpad(month::VARCHAR, 2, '0') || '-' || lpad(day::VARCHAR, 2, '0') AS publication_date, sha256(abstract) AS hash, 'CSV' AS bdd FROM g")
def csv_round_trip(spark, d):
    """All documents written as a corpus CSV and read back."""
    path = _folder(spark, "csv")
    writers.write_csv(_flat(spark, d), path)
    return readers.read(spark, "Csv", path).select("title", "source", "publication_year", "publication_month", "publication_day", "publication_date", F.sha2("abstract", 256).alias("hash"), "bdd")


@query(f"WITH {FLAT} SELECT title, source, year AS publication_year, sha256(abstract) AS hash, 'A. Author; B. Writer' AS authors FROM g")
def ris_round_trip(spark, d):
    """All documents written as tagged records and read back; repeated tags are joined."""
    path = _folder(spark, "ris")
    f = _flat(spark, d)
    record = F.concat_ws("\n", F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), "title"), F.lit("AU  - A. Author"), F.lit("AU  - B. Writer"), F.concat(F.lit("JF  - "), "source"), F.concat(F.lit("PY  - "), F.col("publication_year").cast("string")), F.concat(F.lit("AB  - "), "abstract"), F.lit("ER  - "))
    f.select(record.alias("value")).write.text(path)
    return readers.read(spark, "RIS", path).select("title", "source", "publication_year", F.sha2("abstract", 256).alias("hash"), "authors")


@query(f"WITH {FLAT} SELECT title, source, year AS publication_year, sha256(abstract) AS hash FROM g")
def wos_round_trip(spark, d):
    path = _folder(spark, "wos")
    record = F.concat_ws("\n", F.lit("PT J"), F.concat(F.lit("TI "), "title"), F.concat(F.lit("SO "), "source"), F.concat(F.lit("PY "), F.col("publication_year").cast("string")), F.concat(F.lit("AB "), "abstract"), F.lit("ER"))
    _flat(spark, d).select(record.alias("value")).write.text(path)
    return readers.read(spark, "WOS", path).select("title", "source", "publication_year", F.sha2("abstract", 256).alias("hash"))


@query(f"WITH {FLAT} SELECT source, year::VARCHAR AS year, sha256(abstract) AS hash FROM g WHERE abstract NOT LIKE '%**** %'")
def iramuteq_round_trip(spark, d):
    path = _folder(spark, "iramuteq")
    f = _flat(spark, d).where("NOT abstract LIKE '%**** %'")
    f.select(F.concat(F.lit("**** *source_"), "source", F.lit(" *year_"), F.col("publication_year").cast("string"), F.lit("\n"), "abstract").alias("value")).write.text(path)
    return readers.read(spark, "Iramuteq", path).select(F.element_at("marks", F.lit("source")).alias("source"), F.element_at("marks", F.lit("year")).alias("year"), F.sha2("text", 256).alias("hash"))


@query(f"WITH {FLAT} SELECT doc_id, title, sha256(abstract) AS hash, '3' AS version FROM g")
def json_sink(spark, d):
    path = _folder(spark, "json")
    writers.write_json(_flat(spark, d), path, "3")
    return spark.read.schema("doc_id long, title string, abstract string, version string").json(path).select("doc_id", "title", F.sha2("abstract", 256).alias("hash"), "version")


@query("SELECT substring(sha256(text), 1, 2) AS prefix, count(*) AS n FROM documents GROUP BY 1")
def content_addressed(spark, d):
    """Documents written to folders by the first letters of their hash."""
    path = _folder(spark, "hash")
    writers.write_by_hash(ad.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), path)
    return spark.read.schema("doc_id long, hash string, prefix string").parquet(path).groupBy("prefix").agg(F.count("*").alias("n"))


@query(r"WITH s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM documents) SELECT doc_id, len(ss)::BIGINT AS n_sentences, len(range(1, len(ss) + 1, 7))::BIGINT AS n_parts FROM s")
def documents_exploded(spark, d):
    """Sentences of each document, and the titled paragraphs it is exploded into."""
    docs = ad.read(spark, d, "documents").select("doc_id", F.col("text").alias("abstract"), F.lit("").alias("title"))
    s = docs.select("doc_id", F.size(tx.sentences("abstract")).cast("long").alias("n_sentences"))
    parts = readers.exploded(docs).groupBy("doc_id").agg(F.count("*").alias("n_parts"))
    return s.join(parts, "doc_id", "left").na.fill(0, ["n_parts"])


# ---- answers of services, taken apart


def _escaped(c):
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


#: Characters that XML can't hold are left out of the texts given to it.
PLAIN_TEXT = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g'))"


def _plain(spark, d):
    text = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"\s+", " "))
    return ad.read(spark, d, "documents").select("doc_id", "source", (F.lit(1990) + F.col("doc_id") % 30).cast("string").alias("year"), text.alias("text")).where("text <> ''")


def _tags(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


SERVICE = "SELECT {bdd} AS bdd, 'Title <' || doc_id || '>' AS title, sha256(x) AS hash, {source} AS source, 'Ann Lee, Bo Li' AS authors, {date} AS publication_date FROM (SELECT *, " + PLAIN_TEXT + " AS x, 1990 + doc_id % 30 AS y FROM documents) WHERE x <> ''"


def _read(answers, service):
    return services.documents(answers, service).select("bdd", "title", F.sha2("abstract", 256).alias("hash"), "source", "authors", "publication_date")


@query(SERVICE.format(bdd="'PubMed'", source="source", date="y || '-02-01'"))
def service_pubmed(spark, d):
    """Answers with two authors and a date of year and month, parsed as documents."""
    p = _plain(spark, d)
    author = lambda a, b: f"<Author><LastName>{b}</LastName><ForeName>{a}</ForeName></Author>"
    answer = _tags("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>", F.col("doc_id").cast("string"), "</PMID><Article><Journal><Title>", F.col("source"), "</Title></Journal><ArticleTitle>Title &lt;", F.col("doc_id").cast("string"), "&gt;</ArticleTitle><Abstract><AbstractText>", _escaped(F.col("text")), "</AbstractText></Abstract><AuthorList>" + author("Ann", "Lee") + author("Bo", "Li") + "</AuthorList><ArticleDate><Year>", F.col("year"), "</Year><Month>02</Month></ArticleDate></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>")
    return _read(p.select(answer.alias("answer")), "pubmed")


@query(SERVICE.format(bdd="'Arxiv'", source="'Arxiv'", date="y || '-03-04'"))
def service_arxiv(spark, d):
    p = _plain(spark, d)
    answer = _tags("<feed><entry><id>http://x/", F.col("doc_id").cast("string"), "</id><title>Title &lt;", F.col("doc_id").cast("string"), "&gt;</title><summary>", _escaped(F.col("text")), "</summary><published>", F.col("year"), "-03-04T10:00:00Z</published><author><name>Ann Lee</name></author><author><name>Bo Li</name></author></entry></feed>")
    return _read(p.select(answer.alias("answer")), "arxiv")


def _title():
    return F.concat(F.lit("Title <"), F.col("doc_id").cast("string"), F.lit(">"))


@query(SERVICE.format(bdd="'Hal'", source="source", date="y || '-05-06'"))
def service_hal(spark, d):
    docs = F.struct(F.array(_title()).alias("title_s"), F.array("text").alias("abstract_s"), F.col("source").alias("source_s"), F.array(F.lit("Ann Lee"), F.lit("Bo Li")).alias("authFullName_s"), F.concat("year", F.lit("-05-06 10:00:00")).alias("submittedDate_s"))
    return _read(_plain(spark, d).select(F.to_json(F.struct(F.struct(F.array(docs).alias("docs")).alias("response"))).alias("answer")), "hal")


@query(SERVICE.format(bdd="'Istex'", source="source", date="y || '-01-01'"))
def service_istex(spark, d):
    person = lambda n: F.struct(F.lit(n).alias("name"), F.array(F.lit("Lab")).alias("affiliations"))
    hit = F.struct(F.col("doc_id").cast("string").alias("id"), _title().alias("title"), F.col("text").alias("abstract"), F.array(person("Ann Lee"), person("Bo Li")).alias("author"), F.col("year").alias("publicationDate"), F.struct(F.col("source").alias("title")).alias("host"))
    return _read(_plain(spark, d).select(F.to_json(F.struct(F.lit(1).alias("total"), F.array(hit).alias("hits"))).alias("answer")), "istex")


@query(SERVICE.format(bdd="'Isidore'", source="source", date="y || '-07-08'"))
def service_isidore(spark, d):
    doc = F.struct(F.struct(_title().alias("title"), F.col("text").alias("abstract"), F.array(F.lit("Ann Lee"), F.lit("Bo Li")).alias("creators"), F.concat("year", F.lit("-07-08")).alias("date"), "source").alias("isidore"))
    nested = F.struct(F.struct(F.struct(F.struct(F.array(doc).alias("reply")).alias("content")).alias("replies")).alias("response"))
    return _read(_plain(spark, d).select(F.to_json(nested).alias("answer")), "isidore")


@query("SELECT 'u' || doc_id AS uri, CASE WHEN doc_id % 2 = 0 THEN source END AS label FROM documents")
def graph_query_rows(spark, d):
    """Rows of answers to graph queries; optional names are null where they are missing."""
    value = lambda c: F.struct(F.lit("literal").alias("type"), c.alias("value"))
    one = F.map_from_entries(F.filter(F.array(F.struct(F.lit("uri"), value(F.concat(F.lit("u"), F.col("doc_id").cast("string")))), F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("label"), value(F.col("source"))))), lambda e: e.isNotNull()))
    answers = ad.read(spark, d, "documents").select(F.to_json(F.struct(F.struct(F.array(one).alias("bindings")).alias("results"))).alias("answer"))
    return services.bindings(answers, "uri", "label")


# ---- commits of lists, similarities of the dense kernels, small kits

LOG = "lg AS (SELECT event_id AS version, 'u' || user_id AS term, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old_list, event_type AS new_list FROM events)"


def _log(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return ad.read(spark, d, "events").select(F.col("event_id").alias("version"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), F.lag("event_type").over(w).alias("old_list"), F.col("event_type").alias("new_list"))


OURS = "m AS (SELECT max(version) AS v FROM lg), ours AS (SELECT DISTINCT 'u' || user_id AS term, NULL AS old_list, 'view' AS new_list FROM events WHERE user_id % 3 = 0), since AS (SELECT term, arg_max(new_list, version) AS n, arg_max(coalesce(old_list, '-'), version) AS o FROM lg WHERE version > (SELECT v // 2 FROM m) GROUP BY term)"


def _commit(spark, d):
    log = _log(spark, d)
    ours = ad.read(spark, d, "events").where("user_id % 3 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), F.lit(None).cast("string").alias("old_list"), F.lit("view").alias("new_list")).distinct()
    return terms.commit(log, ours, log.agg(F.max("version")).first()[0] // 2)


@query(f"WITH {LOG}, {OURS} SELECT (SELECT v FROM m) + 1 AS version, term, n AS old_list, 'view' AS new_list FROM ours LEFT JOIN since USING (term) WHERE n IS DISTINCT FROM 'view'")
def list_commit(spark, d):
    """A commit on the middle version of a log: where others changed a term since, the committer's patch wins from what they left."""
    return _commit(spark, d)[0]


@query(f"WITH {LOG}, {OURS} SELECT term, nullif(o, '-') AS old_list, n AS new_list FROM since WHERE term NOT IN (SELECT term FROM ours)")
def list_commit_lacking(spark, d):
    """What the committer lacks of the others' changes."""
    return _commit(spark, d)[1]


@query(f"WITH {LOG} SELECT term, arg_max(new_list, version) AS list FROM lg WHERE version <= 500 GROUP BY term")
def list_state_at(spark, d):
    return terms.state_at(spark.createDataFrame([], "term string, list string"), _log(spark, d), 500)


@query(f"WITH {LOG} SELECT version, term, old_list, new_list FROM lg WHERE version > 5")
def list_history(spark, d):
    return terms.history(_log(spark, d), 5)


@query("SELECT l AS term, (length(l) - length(replace(l, ' ', '')) + 1)::INT AS size, CASE p_size % 3 WHEN 0 THEN 'MapTerm' WHEN 1 THEN 'StopTerm' ELSE 'CandidateTerm' END AS list, NULL AS root FROM (SELECT p_name || ' ' || p_partkey AS l, p_size FROM part) UNION ALL SELECT 'form ' || p_partkey, 2, CASE p_size % 3 WHEN 0 THEN 'MapTerm' WHEN 1 THEN 'StopTerm' ELSE 'CandidateTerm' END, p_name || ' ' || p_partkey FROM part")
def list_uploaded(spark, d):
    p = ad.read(spark, d, "part")
    status = F.when(F.col("p_size") % 3 == 0, "map").when(F.col("p_size") % 3 == 1, "stop").otherwise("main")
    label = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    rows = p.select(status.alias("status"), label.alias("label"), F.concat(label, F.lit("|&|form "), F.col("p_partkey").cast("string")).alias("forms"))
    return terms.uploaded(rows).select("term", F.col("size").cast("int").alias("size"), "list", "root")


@query(f"""WITH {TOK}, {KERNEL}, mi AS (SELECT x, y, n / a.nt * (n / b.nt) AS mi FROM off JOIN diag a ON a.t = x JOIN diag b ON b.t = y), tot AS (SELECT x, sum(mi) AS total FROM mi GROUP BY x),
top AS (SELECT a.x, b.x AS y, sum(least(a.mi, b.mi)) AS top FROM mi a JOIN mi b ON a.y = b.y AND a.x <> b.x GROUP BY ALL), r AS (SELECT x, y, top / nullif(total - coalesce(mi, 0), 0) AS v FROM top JOIN tot USING (x) LEFT JOIN mi USING (x, y))
SELECT x, y, round(v, 6) AS value FROM r WHERE v > 0 UNION ALL SELECT x, x, 1 FROM tot WHERE total > 0""")
def distributional_square(spark, d):
    return similarity.distributional(ad.map_cooc(spark, d, ad.KERNEL_TERMS)).withColumn("value", F.round("value", 6))


@query(f"""WITH {TOK}, {KERNEL}, s AS (SELECT x, sum(n) AS s FROM off GROUP BY x), mi AS (SELECT x, y, ln((SELECT sum(s) FROM s) * n / (a.s * b.s)) AS mi FROM off JOIN s a USING (x) JOIN (SELECT x AS y, s FROM s) b USING (y) WHERE ln((SELECT sum(s) FROM s) * n / (a.s * b.s)) > 0), tot AS (SELECT x, sum(mi) AS total FROM mi GROUP BY x),
top AS (SELECT a.x, b.x AS y, sum(least(a.mi, b.mi)) AS top FROM mi a JOIN mi b ON a.y = b.y AND a.x <> b.x GROUP BY ALL), r AS (SELECT x, y, round(coalesce(top / nullif(total - coalesce(mi, 0), 0), 0), 12) AS v FROM top JOIN tot USING (x) LEFT JOIN mi USING (x, y)),
f AS (SELECT min(coalesce(m, 0)) AS f FROM diag LEFT JOIN (SELECT y AS t, max(v) AS m FROM r GROUP BY y) USING (t)) SELECT a.x, a.y, round(a.v, 6) AS value FROM r a LEFT JOIN r b ON a.x = b.y AND a.y = b.x, f WHERE a.v > f AND a.v > coalesce(b.v, 0)""")
def distributional_links(spark, d):
    return similarity.distributional_links(ad.map_cooc(spark, d, ad.KERNEL_TERMS)).withColumn("value", F.round("value", 6))


@query(f"WITH {MATRIX}, r AS (SELECT i, min(v) AS v, count(*) AS c FROM m GROUP BY i), q AS (SELECT j, min(v) AS v, count(*) AS c FROM m GROUP BY j) SELECT round((SELECT sum(CASE WHEN c < 25 THEN least(v, 0) ELSE v END) FROM r), 2) AS rows, round((SELECT sum(CASE WHEN c < 25 THEN least(v, 0) ELSE v END) FROM q), 2) AS columns")
def matrix_minima(spark, d):
    m = _matrix(spark, d)
    r, c = matrix.row_minima_sum(m, 25).select(F.round("v", 2).alias("rows")), matrix.column_minima_sum(m, 25).select(F.round("v", 2).alias("columns"))
    return r.crossJoin(c)  # two single rows


@query(f"WITH {MATRIX} SELECT CASE WHEN i > 7 THEN i - 1 ELSE i END AS i, round(sum(v), 2) AS v FROM m WHERE i <> 7 GROUP BY 1")
def vector_without_place(spark, d):
    return matrix.without_place(matrix.row_sums(_matrix(spark, d)), 7).select("i", F.round("v", 2).alias("v"))


@query("SELECT p_partkey, round(1 - damerau_levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 9) AS norm FROM part")
def damerau_norms(spark, d):
    return ad.read(spark, d, "part").select("p_partkey", F.round(stems.damerau_norm_udf()("p_name", "p_type"), 9).alias("norm"))


@query("SELECT event_id, sha256(props) AS hash FROM events")
def hashed_answers(spark, d):
    h = writers.hashed("props")
    return ad.read(spark, d, "events").select("event_id", h["hash"].alias("hash"))


@query(f"WITH {FLAT} SELECT sha256(title || ' ' || abstract) AS hash FROM g")
def csv_columns_joined(spark, d):
    path = _folder(spark, "csv")
    writers.write_csv(_flat(spark, d), path)
    return readers.read_csv_columns(spark, path, ["title", "abstract"]).select(F.sha2("text", 256).alias("hash"))
