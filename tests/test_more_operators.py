"""Matrices, accounts, counters, series, classifiers, endpoints and the rest of the temporal operators on small fixtures."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexispark.functions import english
from lexispark.operators import accounts, classify, counters, graph, matrix, phylo, series, similarity
from lexispark.plans import api


def cells(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


@pytest.fixture
def square(spark):
    m = [[7, 4, 0], [4, 5, 3], [0, 3, 4]]
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v], "i long, j long, v double")


def test_matrix(spark, square):
    assert cells(matrix.row_sums(square), "i", "v") == {(0,): 11, (1,): 12, (2,): 7}
    assert cells(matrix.column_sums(square, diagonal=False), "j", "v") == {(0,): 4, (1,): 7, (2,): 3}
    assert cells(matrix.product(square, matrix.identity(spark, 3)), "i", "j", "v") == cells(square, "i", "j", "v")
    assert cells(matrix.divide_by_diagonal(square), "i", "j", "v")[0, 1] == pytest.approx(0.8)
    assert matrix.elementwise(square, square, lambda a, b: a - b).count() == 0
    assert matrix.total(square).first().v == 30
    got = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 5]), ([2], [3])], "a array<int>, b array<int>").select(matrix.common_prefix("a", "b").alias("p")).collect()
    assert [r.p for r in got] == [[1, 2], [1], []]
    ix = matrix.indexed_terms(spark.createDataFrame([("b",), ("a",)], "term string"))
    assert cells(ix, "term", "index") == {("a",): 0, ("b",): 1}
    assert cells(matrix.labels_of(ix, spark.createDataFrame([(1, [1, 0])], "k int, indices array<int>"), "k"), "k", "label") == {(1,): "b | a"}


def test_conditional_and_budget(spark):
    c = spark.createDataFrame([("a", "a", 4), ("b", "b", 2), ("b", "a", 2)], "x string, y string, n long")
    assert cells(similarity.conditional(c), "x", "y", "value") == {("a", "b"): 1.0}
    m = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "c", 0.1)], "x string, y string, value double")
    assert cells(similarity.symmetrised(m), "x", "y", "value") == {("b", "a"): 0.7, ("a", "c"): 0.1}
    assert similarity.link_budget(m, 1, order=2).count() == 0
    assert cells(similarity.maxmini(m), "x", "y", "value") == {}
    with pytest.raises(Exception, match="impossible"):
        spark.range(1).select(similarity.tficf(F.lit(5.0), F.lit(2.0), F.lit(1.0), F.lit(9.0))).collect()


def test_log_distributional_against_dense(spark):
    import math
    import random

    r = random.Random(1)
    n = 9
    dense = [[0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            dense[i][j] = dense[j][i] = r.choice([0, 0, 1, 3, 9])
    rows = [(f"t{i}", f"t{j}", dense[i][j]) for i in range(n) for j in range(i) if dense[i][j]]
    s = [sum(x) for x in dense]
    whole = sum(s)
    mi = [[math.log(whole * dense[i][j] / (s[i] * s[j])) if dense[i][j] else 0.0 for j in range(n)] for i in range(n)]
    got = cells(similarity.log_distributional(spark.createDataFrame(rows, "x string, y string, n long"), keep_all=True), "x", "y", "value")
    for i in range(n):
        for j in range(n):
            if i != j and s[i] and s[j]:
                top = sum(min(mi[i][k], mi[j][k]) for k in range(n) if k not in (i, j))
                bottom = sum(mi[i][k] for k in range(n) if k not in (i, j))
                assert got[f"t{i}", f"t{j}"] == pytest.approx(top / bottom if bottom else 0.0)


def nodes(spark):
    rows = [(1, 1, 7, None, "ann"), (2, 20, 7, 1, "private"), (3, 30, 7, 2, "corpus"), (4, 4, 7, 3, "doc"), (5, 210, 8, 1, "team"), (6, 22, 7, 1, "public")]
    return spark.createDataFrame(rows, "id long, typename int, user_id long, parent_id long, name string")


def test_accounts(spark):
    users = spark.createDataFrame([(7, "ann"), (8, "bob")], "id long, username string")
    n = nodes(spark)
    assert accounts.root_of(users, n, "ann").first().id == 1
    assert accounts.get_or_make_root(users, n, "ann").count() == 6
    made = accounts.get_or_make_root(users, n, "bob")
    assert made.count() == 10 and accounts.get_or_make_root(users, made, "bob").count() == 10
    links = spark.createDataFrame([(6, 3), (6, 5)], "folder long, node long")
    kept, left = accounts.delete_node(n, links, 2, 7)
    assert {r.id for r in kept.collect()} == {1, 5, 6} and {r.node for r in left.collect()} == {5}
    same, unlinked = accounts.delete_node(n, links, 5, 7)
    assert same.count() == 6 and {r.node for r in unlinked.collect()} == {3}
    with pytest.raises(ValueError):
        accounts.delete_node(n, links, 1, 7)
    assert accounts.share(links, 4, 6, n).count() == 3
    with pytest.raises(ValueError):
        accounts.share(links, 4, 3, n)
    assert accounts.public_folders(n, links).first().shared == [3, 5]
    assert {r.id for r in accounts.below_of_types(n, n.where("id = 1").select("id"), [4], [20, 30]).collect()} == {4}
    assert accounts.rename(n, 3, "x" * 300).where("id = 3").first().name == "x" * 255
    given = accounts.update_given(users, spark.createDataFrame([(8, None), (7, "anna")], "id long, username string"), "id")
    assert cells(given, "id", "username") == {(7,): "anna", (8,): "bob"}


def test_deltas_equal_recount(spark):
    occ = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "context_id long, term string")
    changes = spark.createDataFrame([("c", 1, None, 1), ("c", 2, None, 0), ("c", 2, 0, 2), ("c", 1, 1, 0)], "corpus string, context_id long, old int, new int")
    assert cells(counters.after_changes(changes, occ), "corpus", "term", "n") == {("c", "a"): 1}
    assert counters.sampled(occ, 2, "context_id").count() == 2


def test_series(spark):
    s = spark.createDataFrame([(1, 1), (2, 5), (3, 2), (4, 2), (5, 9), (6, 1)], "x int, y int")
    assert [r.x for r in series.local_maxima(s, "x", "y").orderBy("x").collect()] == [2, 5]
    assert [r.before for r in series.running_before(s, "x", "y").orderBy("x").collect()] == [0, 1, 6, 8, 10, 19]
    t = spark.sql("select date'2001-02-03' d")
    assert t.select(series.time_unit("d", "month")).first()[0] == 2001 * 12 + 1
    g = spark.createDataFrame([("p", "b", 2), ("p", "a", 2), ("q", "a", 0)], "g string, k string, v int")
    assert cells(series.positive_argmax(g, "g", "k", "v"), "g", "k") == {("p",): "a"}


def test_english_tokeniser():
    assert english.tokenise("didn't (x), a@b.co") == ["did", "n't", "(", "x", "),", "a@b.co"]
    assert english.tokenise("It's http://a.b/c, \"we'll\" see.") == ["It", "'s", "http://a.b/c,", '"', "we", "'ll", '"', "see", "."]


def test_classifier(spark):
    rows = spark.createDataFrame([(float(i % 2), i % 2 + (i % 7) / 20, (i % 5) / 9) for i in range(60)], "label double, a double, b double")
    model = classify.train_kinds(rows, ["a", "b"])
    out = classify.predict_kinds(model, rows, ["a", "b"])
    assert out.where("label = prediction").count() >= 57


def test_bridges_and_confluence(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.5), (1, 4, 0.4), (4, 5, 0.9)], "src long, dst long, weight double")
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 2)], "node long, cluster int")
    kept = {(r.src, r.dst) for r in graph.bridge_links(e, c, 0.4).collect()}
    assert kept == {(1, 2), (2, 3), (4, 5)}
    conf = cells(graph.confluence(e, 2), "x", "y", "value")
    assert all(0 < v < 1 for v in conf.values()) and conf[1, 2] > conf[1, 5]
    label = cells(graph.communities(e), "node", "community")
    assert set(n for (n,) in label) == {1, 2, 3, 4, 5}


def test_diamond_counts(spark, monkeypatch):
    """Equal to the pairs made group by group, with nulls and repeated rows; classes are set beside a parent once."""
    import random

    from lexispark.operators import occurrences

    r = random.Random(5)
    down = [(r.choice([1, 2, 3, None]), r.choice([*range(9), None])) for _ in range(60)]
    up = [(m, c) for m in [*range(12), None] for c in ([7, 8, None] if (m or 0) % 2 else [8, 9, 10]) for _ in range(2)]
    mids = defaultdict(set)
    for p, m in down:
        for k, c in up:
            if m is not None and m == k:
                mids[p, c].add(m)
    want = {(p, c, len(s)) for (p, c), s in mids.items() if len(s) > 1}
    frames = [spark.createDataFrame(down, "parent long, mid long"), spark.createDataFrame(up, "mid long, child long")]
    assert want and {tuple(x) for x in phylo.diamond_counts(*frames).select("parent", "child", "n").collect()} == want
    monkeypatch.setattr(occurrences, "small", lambda *a: False)
    assert {tuple(x) for x in phylo.diamond_counts(*frames).select("parent", "child", "n").collect()} == want


def test_more_phylo(spark):
    cooc = spark.createDataFrame([("a", "a", 4), ("b", "b", 2), ("c", "c", 3), ("b", "a", 2), ("c", "a", 1)], "x string, y string, n long")
    g = spark.createDataFrame([("1", 1, 3, ["a", "b", "c"], "x"), ("2", 4, 6, ["a", "b"], "x"), ("3", 7, 9, ["a", "c"], "y")], "id string, first int, last int, terms array<string>, branch string")
    assert cells(phylo.inclusive_labels(g, cooc, 1), "id", "label")[("2",)] in ("a", "b")
    assert cells(phylo.confidence(cooc), "x", "y", "value") == {("b", "a"): 1.0, ("c", "a"): pytest.approx(1 / 3)}
    df = spark.createDataFrame([(t, 2) for t in "abc"], "term string, n_docs long")
    links = spark.createDataFrame([("1", "2", 0.6)], "src string, dst string, similarity double")
    assert {r.head for r in phylo.ancestors(g, links, df, 9).collect()} == {"3"}
    d = phylo.diamonds(spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "4"), ("3", "4")], "src string, dst string")).first()
    assert (d.parent, d.child, d.between) == ("1", "4", ["2", "3"])
    w = phylo.weighted_itemsets(spark.createDataFrame([(["a", "b"],)], "items array<string>"), spark.createDataFrame([(["a", "b", "c"], 2.0, ["s"]), (["a"], 1.0, ["t"]), (["b", "a"], 1.0, ["u"])], "terms array<string>, weight double, sources array<string>")).first()
    assert (w.support, w.weight, w.sources) == (2, 3.0, ["s", "u"])
    assert phylo.ladder(0.1, 0.3) == [0.1, 0.4, 0.7, 1.0] and phylo.evolving_ladder([(0.1, 1), (0.2, 3), (0.3, 2)]) == [0.2]
    s = phylo.weighted_similarity(spark.createDataFrame([(["a", "b"], ["a"])], "a array<string>, b array<string>"), df, 9).first()
    assert s.similarity == pytest.approx(1.0)


def test_endpoints(spark):
    c = spark.createDataFrame([(1, "t1", "x", 2000, 1.0), (2, "t2", "y", 2001, 1.0)], "id long, title string, abstract string, year int, score double")
    links = spark.createDataFrame([("k", 1, 1), ("k", 2, 0)], "corpus string, context_id long, category int")
    page, n = api.document_table(c, links, "Trash")
    assert [r.id for r in page.collect()] == [2] and n.first().n == 1
    with pytest.raises(ValueError):
        api.document_table(c, links, "Other")
    docs = spark.createDataFrame([(1, "running dogs", "en"), (2, None, "en"), (3, "le chien", "fr")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in api.search_documents(docs, "dog runs").collect()] == [1]


def test_distributional_goldens(spark):
    """Three and four terms: published values of the definition."""
    from lexispark.operators import similarity

    def cells(m):
        rows = [(f"t{i}", f"t{j}", m[i][j]) for i in range(len(m)) for j in range(i + 1) if m[i][j]]
        got = {(r.x, r.y): r.value for r in similarity.distributional(spark.createDataFrame(rows, "x string, y string, n long")).collect()}
        return [[got.get((f"t{i}", f"t{j}"), 0.0) for j in range(len(m))] for i in range(len(m))]

    assert cells([[7, 4, 0], [4, 5, 3], [0, 3, 4]]) == [pytest.approx(r) for r in ([1, 0, 0.984375], [0, 1, 0], [1, 0, 1])]
    want = ([1, 0, 0.5714285714, 0.8421052632], [0, 1, 1, 1], [0.0833333333, 0.046875, 1, 0.25], [0.3333333333, 0.0576923077, 1, 1])
    assert cells([[4, 1, 2, 1], [1, 4, 0, 0], [2, 0, 3, 3], [1, 0, 3, 3]]) == [pytest.approx(r) for r in want]


def test_commit_against_a_newer_log(spark):
    from lexispark.operators import terms

    schema = "version long, term string, old_list string, new_list string"
    log = spark.createDataFrame([(1, "a", None, "MapTerm"), (2, "b", None, "MapTerm"), (3, "a", "MapTerm", "StopTerm")], schema)
    ours = spark.createDataFrame([("a", "MapTerm", "CandidateTerm"), ("c", None, "MapTerm")], "term string, old_list string, new_list string")
    rows, lacking, version = terms.commit(log, ours, 1)
    assert version == 4 and {tuple(r) for r in rows.collect()} == {(4, "a", "StopTerm", "CandidateTerm"), (4, "c", None, "MapTerm")}
    assert [tuple(r) for r in lacking.collect()] == [("b", None, "MapTerm")]
    none = spark.createDataFrame([], "term string, list string")
    assert {tuple(r) for r in terms.state_at(none, log.union(rows)).collect()} == {("a", "CandidateTerm"), ("b", "MapTerm"), ("c", "MapTerm")}
    assert {tuple(r) for r in terms.state_at(none, log, 2).collect()} == {("a", "MapTerm"), ("b", "MapTerm")}
    assert terms.commit(log, ours.where("term = 'zz'"), 3)[0].count() == 0
    with pytest.raises(ValueError, match="isn't known"):
        terms.commit(log, ours, 9)


def test_trees_with_cycles_are_an_error(spark):
    from lexispark.operators import tree

    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    assert {(r.id, r.depth) for r in tree.descendants(nodes, nodes.where("id = 'a'").select("id")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError, match="cycle"):
        tree.descendants(nodes, nodes.where("id = 'x'").select("id"), most=5)
    with pytest.raises(ValueError, match="cycle"):
        tree.ancestors(nodes, nodes.where("id = 'y'").select("id"), most=5)


def test_long_forms_and_long_paths(spark):
    """No bound on words of a form, or on the length of a chain of edges."""
    from lexispark.operators import extraction, graph

    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"before {words}, after"), (2, "w0 w1"), (3, None), (4, "")], "doc_id long, text string")
    forms = spark.createDataFrame([("long", words), ("short", "w0 w1"), ("one", "w1")], "label string, form string")
    got = {tuple(r) for r in extraction.match_dictionary(docs, forms).collect()}
    assert got == {(1, "long", 1), (1, "one", 1), (2, "short", 1), (2, "one", 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert {tuple(r) for r in graph.components(chain).collect()} == {(i, 0) for i in range(301)}


def test_services_with_several_records(spark):
    from lexispark.sources import services

    entry = lambda k: f"<entry><id>u{k}</id><title> T\n {k} </title><summary>S {k}</summary><published>2001-02-03T00:00:00Z</published><author><name>A</name></author></entry>"
    answers = spark.createDataFrame([(f"<feed>{entry(1)}{entry(2)}</feed>",), ("<feed></feed>",), ("no answer",), (None,)], "answer string")
    rows = sorted(services.documents(answers, "arxiv").collect(), key=lambda r: r.url)
    assert [(r.url, r.title, r.abstract, r.publication_year, r.publication_month) for r in rows] == [("u1", "T 1", "S 1", 2001, 2), ("u2", "T 2", "S 2", 2001, 2)]
    with pytest.raises(ValueError, match="unknown service"):
        services.documents(answers, "none")
    assert 'contains(?title, "a \\"b")' in services.isidore_query('a "b', 5) and "wd:Q42" in services.wikidata_query("Q42", 3)


def test_graph_file_of_any_size(spark):
    from xml.etree import ElementTree

    from lexispark.sources import writers

    nodes = spark.createDataFrame([(i, f'<"{i}">&', i) for i in range(30)], "id long, label string, size long")
    edges = spark.createDataFrame([(i, i + 1, 0.5) for i in range(29)], "src long, dst long, weight double")
    root = ElementTree.fromstring("\n".join(r.value for r in writers.gexf_lines(nodes.repartition(5), edges).collect()).split("?>", 1)[1])
    space = "{http://www.gexf.net/1.3}"
    assert [n.get("label") for n in root.iter(f"{space}node")] == [f'<"{i}">&' for i in range(30)] and len(list(root.iter(f"{space}edge"))) == 29
