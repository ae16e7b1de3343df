"""Operators on small fixtures: published golden values, edge cases, round trips."""

import json
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexispark.functions import stem, text
from lexispark.operators import corpus, extraction, graph, occurrences, phylo, relations, search, similarity, terms, tree
from lexispark.sources import connectors, readers, writers
from lexispark.streaming import ingest

SENTENCES = ["There is a table with a glass of wine and a spoon.", "I can see the glass on the table.", "There was only a spoon on that table.", "The glass just fall from the table, pouring wine everywhere.", "I wish the glass did not contain wine."]
WORDS = ["glass", "spoon", "table", "wine"]


@pytest.fixture
def cooc(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    return occurrences.cooccurrence(occurrences.occurrences(docs).where(F.col("term").isin(WORDS)))


def cells(df, *cols):
    return {tuple(r[c] for c in cols[:-1]): r[cols[-1]] for r in df.collect()}


def test_cooccurrence_of_five_sentences(cooc):
    want = {("glass", "glass"): 4, ("spoon", "glass"): 1, ("spoon", "spoon"): 2, ("table", "glass"): 3, ("table", "spoon"): 2, ("table", "table"): 4, ("wine", "glass"): 3, ("wine", "spoon"): 1, ("wine", "table"): 2, ("wine", "wine"): 3}
    assert cells(cooc, "x", "y", "n") == want


def test_inclusion_and_specificity_golden(cooc):
    got = {r.term: (r.inclusion, r.specificity) for r in similarity.inclusion_specificity(cooc).collect()}
    for t, i, s in zip(WORDS, (0.5833, 0.5833, 0.75, 0.5833), (-0.5833, -0.4167, 0.4167, 0.5833)):
        assert got[t] == (pytest.approx(i, abs=1e-4), pytest.approx(s, abs=1e-4))


def test_porter():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor conflated conflat hopping hop falling fall filing file happy happi relational relat conditional condit hopefulness hope revival reviv adjustment adjust adoption adopt probate probat rate rate controlling control".split()
    for w, s in zip(pairs[::2], pairs[1::2]):
        assert stem.porter(w) == s
    assert stem.porter("it") == "it" and stem.group_key("social-network analysis") == stem.group_key("analysis network social")


def test_distances(spark):
    assert stem.damerau("nose", "ones") == 2 and stem.damerau("", "ab") == 2 and stem.damerau("ab", "ba") == 1
    df = spark.createDataFrame([("xxx", "xyx"), ("", ""), ("ab", "abc"), (None, "a")], "a string, b string")
    got = df.select(text.char_jaccard("a", "b").alias("j"), text.hamming("a", "b").alias("h"), text.levenshtein_norm("a", "b").alias("l")).collect()
    assert [r.j for r in got][:3] == [0.5, 1.0, pytest.approx(2 / 3)]
    assert [r.h for r in got] == [1, 0, None, None]
    assert got[1].l == 1.0


def test_hashes_and_windows(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"], "abcde")], "x array<string>, y array<string>, t string")
    r = df.select(text.set_hash("x").alias("a"), text.set_hash("y").alias("b"), text.char_windows("t", 2).alias("w"), text.char_windows("t", 9).alias("none")).first()
    assert r.a == r.b and r.w == ["abc", "bcd", "cde"] and r.none == []


def test_cleaning(spark):
    df = spark.createDataFrame([("see http://a.b/c now 12-34-5 and 77", "It’s;\tso")], "a string, b string")
    r = df.select(text.clean_for_tagging("a").alias("a"), text.clean_bytes("b").alias("b")).first()
    assert r.a == "see now and 77" and r.b == "It's. so"


def list_state(spark):
    rows = [(f"term{i}", 1, kind, None, None, [], list(range(n))) for i, (kind, n) in enumerate([("MapTerm", 5), ("MapTerm", 4), ("MapTerm", 3), ("MapTerm", 2), ("StopTerm", 6), ("StopTerm", 5), ("CandidateTerm", 8), ("CandidateTerm", 5)])]
    return spark.createDataFrame(rows, "term string, size int, list string, root string, parent string, children array<string>, occurrences array<int>")


def test_term_pages(spark):
    s = list_state(spark)
    page, n = terms.search_terms(s, kind="MapTerm", order="ScoreDesc", offset=1, limit=2)
    assert [r.term for r in page.collect()] == ["term1", "term2"] and n.first().n == 4
    page, n = terms.search_terms(s, part="TERM7")
    assert [r.term for r in page.collect()] == ["term7"] and n.first().n == 1


def test_patch_goes_to_children(spark):
    s = spark.createDataFrame([("a", 1, "MapTerm", None, None, ["b"]), ("b", 1, "MapTerm", "a", "a", []), ("c", 1, "MapTerm", None, None, [])], "term string, size int, list string, root string, parent string, children array<string>")
    p = spark.createDataFrame([(1, "a", "MapTerm", "StopTerm"), (2, "zzz", "MapTerm", "StopTerm")], "version long, term string, old_list string, new_list string")
    assert {r.term: r.list for r in terms.apply_patches(s, p).collect()} == {"a": "StopTerm", "b": "StopTerm", "c": "MapTerm"}
    moved = terms.reroot(s, spark.createDataFrame([("a", "c")], "term string, parent string"))
    assert {r.term: r.root for r in moved.collect()} == {"a": "c", "b": "c", "c": None}


def test_grammar():
    tags = [("big", "JJ"), ("red", "JJ"), ("house", "NP"), ("of", "IN"), ("the", "DT"), ("king", "NP")]
    assert [w for w, t in extraction.group_tags(tags) if t == "NP"] == ["big red house", "king"]


def test_segmentation():
    score = {("new", "york"): 2.0, ("new",): 0.1, ("york",): 0.1, ("is",): 0.5}
    assert extraction.segment(["new", "york", "is"], score, 2) == ["new york", "is"]


def test_segmentation_in_blocks(spark, monkeypatch):
    from lexispark.operators import segmentation

    said = ["a b c d a b c a b", None, "", "x", "É a,b", "a b c (a b d) a b c", "x x x x", "d a b", "c a b c é a"]
    d = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(2)
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in enumerate(said)}
    counts = extraction.ngram_counts(d, 3).cache()
    many = {tuple(r.gram) for r in counts.collect() if r.n >= 2}
    score = {tuple(r.gram): r.autonomy for r in extraction.autonomy(counts, 3).collect() if tuple(r.gram) in many}
    want = {(i, t): n for i, w in words.items() for t, n in Counter(extraction.segment(w, score, 3)).items()}
    for block, part in ((1_000_000, 1_000_000), (6, 5)):
        monkeypatch.setattr(segmentation, "BLOCK", block)
        monkeypatch.setattr(segmentation, "PART", part)
        out = extraction.segment_terms(d)
        assert cells(out, "doc_id", "term", "n") == want
        # no run of words becomes a row
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert extraction.segment_terms(d.where("text IS NULL")).count() == 0


def test_dictionary_longest(spark):
    d = spark.createDataFrame([(1, "Le chat blanc et le chat noir"), (2, None), (3, "")], "doc_id long, text string")
    f = spark.createDataFrame([("chat blanc", "chat blanc"), ("chat", "chat")], "label string, form string")
    assert cells(extraction.match_dictionary(d, f), "doc_id", "label", "n") == {(1, "chat blanc"): 1, (1, "chat"): 1}


def test_key_phrases(spark):
    d = spark.createDataFrame([(1, "the deep learning of deep networks")], "doc_id long, text string")
    assert cells(extraction.key_phrases(d), "doc_id", "phrase", "score") == {(1, "deep learning"): 4.0, (1, "deep networks"): 4.0}


def test_key_phrases_stay_with_their_text(spark):
    rows = [(1, "deep nets\nthe deep nets learn"), (2, "\u00a0one"), (2, "Two\u000btwo one, the"), (None, "lost"), (3, None), (4, "")]
    out = extraction.key_phrases(spark.createDataFrame(rows, "doc_id long, text string"))
    deep = 5 / 2
    assert cells(out, "doc_id", "phrase", "score") == {(1, "deep nets"): 2 * deep, (1, "deep nets learn"): 2 * deep + 3, (2, "one"): 1.5, (2, "two\u000btwo one"): 3.5}
    alone = extraction.key_phrases(spark.createDataFrame(rows[:1], "doc_id long, text string"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5)], "src long, dst long")
    assert cells(graph.components(e), "node", "component") == {(1,): 1, (2,): 1, (3,): 1, (4,): 4, (5,): 4}
    assert sorted(sorted(r.clique) for r in graph.maximal_cliques(e).collect()) == [[1, 2, 3], [4, 5]]
    w = cells(graph.walk(e, spark.createDataFrame([(4,)], "node long"), 1), "start", "node", "p")
    assert w == {(4, 5): 1.0}
    total = graph.walk(e, spark.createDataFrame([(1,)], "node long"), 3).agg(F.sum("p")).first()[0]
    assert total == pytest.approx(1)
    assert graph.degree_filter(e).count() == 3


def test_itemsets_of_every_size(spark, monkeypatch):
    """Equal to brute force, pairs counted or not; FP-growth sees only baskets that may hold a set of three."""
    import itertools
    import random

    r = random.Random(3)
    rows = [r.sample(range(12), r.randint(0, 5)) + [20, 21, 22] * (i % 9 == 0) for i in range(120)] + [[40 + i, 41 + i] for i in range(80)]
    count = {}
    for b in rows:
        for k in range(1, len(b) + 1):
            for c in itertools.combinations(sorted(b), k):
                count[c] = count.get(c, 0) + 1
    often = {c: n for c, n in count.items() if n >= 4}
    want = {c: n for c, n in often.items() if not any(m == n and len(d) == len(c) + 1 and set(c) < set(d) for d, m in often.items())}
    seen, grow = [], graph.fp_growth
    monkeypatch.setattr(graph, "fp_growth", lambda b, least: seen.append(b.count()) or grow(b, least))
    frame = spark.createDataFrame([(b,) for b in rows], "b array<long>")
    found = lambda: {tuple(x["items"]): x["freq"] for x in graph.frequent_itemsets(frame, "b", 4).collect()}
    assert max(map(len, want)) > 2 and found() == want and seen[0] <= 120
    monkeypatch.setattr(graph, "PAIRS", 0)
    assert found() == want and seen[1] == len(rows)
    monkeypatch.undo()
    monkeypatch.setattr(graph, "fp_growth", None)  # no sets of two: nothing to grow
    alone = spark.createDataFrame([([1, 2],), ([1, 3],), ([2],), (None,)], "b array<long>")
    assert {tuple(x["items"]): x["freq"] for x in graph.frequent_itemsets(alone, "b", 2).collect()} == {(1,): 2, (2,): 2}


def test_itemsets(spark):
    b = spark.createDataFrame([(["a", "b"],), (["a", "b"],), (["a", "c"],)], "items array<string>")
    assert cells(graph.frequent_itemsets(b.select("items"), "items", 2).select(F.array_join("items", "").alias("i"), "freq"), "i", "freq") == {("ab",): 2, ("a",): 3}
    assert phylo.closed_sets([(frozenset("ab"), 2), (frozenset("ac"), 1)], 2) == {frozenset("a"): 3, frozenset("ab"): 2}


def test_periods(spark):
    assert phylo.periods(1, 10, 3, 2) == [(1, 3), (3, 5), (5, 7), (7, 9)]
    d = spark.createDataFrame([(i,) for i in range(0, 12)], "date int")
    got = {(r.date, r.first, r.last) for r in phylo.into_periods(d, 1, 10, 3, 2).collect()}
    assert got == {(x, a, b) for x in range(12) for a, b in phylo.periods(1, 10, 3, 2) if a <= x <= b}
    once = phylo.into_periods(d, 1, 10, 3, 2, consuming=True).collect()
    assert len(once) == len({r.date for r in once})


def test_phylo_quality_and_merge(spark):
    g = spark.createDataFrame([("1-1-0", 1, 3, 1, 0, ["a", "b"], 2), ("4-1-0", 4, 6, 1, 0, ["a", "b"], 3), ("4-1-1", 4, 6, 1, 1, ["x", "y"], 2)], "id string, first int, last int, scale int, idx int, terms array<string>, weight long")
    df = spark.createDataFrame([(t, 3) for t in "abxy"], "term string, n_docs long")
    links = phylo.temporal_links(g, df, 30, frame=1, step=3)
    assert cells(links, "src", "dst", "similarity") == {("1-1-0", "4-1-0"): 1.0}
    b = phylo.branches(g, links)
    assert b.select("branch").distinct().count() == 2
    assert phylo.quality(b, 0.5, 4) == pytest.approx(1.0)
    assert cells(phylo.term_dynamics(g), "id", "term", "dynamic")[("1-1-0", "a")] == 1
    assert phylo.branch_labels(b, 1).count() == 2
    assert phylo.synchronic_merge(b, df, 30).count() == 3


def test_fuzzy_join_equals_product(spark):
    a = spark.createDataFrame([(x,) for x in ["smith", "smyth", "jones", "joness", "x", ""]], "a string")
    b = spark.createDataFrame([(x,) for x in ["smithe", "jonse", "y", "mith"]], "b string")
    want = {}
    for r in a.crossJoin(b).withColumn("d", F.levenshtein(F.lower("a"), F.lower("b"))).where("d <= 2").collect():
        want[r.a] = min(want.get(r.a, (9, "")), (r.d, r.b)) if r.a in want else (r.d, r.b)
    got = {r.a: (r.distance, r.b) for r in relations.fuzzy_nearest(a, b, "a", "b").collect()}
    assert got == want


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    n = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "id int, v string")
    assert relations.insert_or_ignore(t, n, ["id"]).count() == 3
    assert cells(relations.update_from(t, n.where("id = 2"), ["id"], "v"), "id", "v") == {(1,): "a", (2,): "x"}
    assert cells(relations.changed(t, n.where("v <> 'd'"), "id", "v"), "id", "change") == {(1,): "delete", (2,): "update", (3,): "insert"}
    assert cells(relations.upsert_report(t, n, "id"), "id", "is_new") == {(2,): False, (3,): True}
    j = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3"}')], "o string, n string").select(relations.merge_json("o", "n").alias("m")).first().m
    assert json.loads(j) == {"a": "1", "b": "3"}


def test_tree(spark):
    n = spark.createDataFrame([("r", None, 1), ("a", "r", 2), ("b", "a", 3), ("c", "b", 3)], "id string, parent_id string, typename int")
    assert cells(tree.descendants(n, spark.createDataFrame([("r",)], "id string")), "id", "depth") == {("r",): 0, ("a",): 1, ("b",): 2, ("c",): 3}
    assert cells(tree.closest_of_type(n, spark.createDataFrame([("c",)], "id string"), 2), "id", "closest") == {("c",): "a"}


def test_documents(spark):
    c = spark.createDataFrame([(1, "A%b", "x", 2000), (2, "Ab", None, 2001)], "id long, title string, abstract string, year int")
    assert [r.id for r in corpus.matching(c, "a%B").collect()] == [1]
    assert search.query_stems("The runners, running!") == ["run", "runner", "the"]


def test_readers(spark, tmp_path):
    p = lambda n, s: (tmp_path / n).write_text(s) and str(tmp_path / n)
    csv = p("a.csv", 'Title,Source,Publication Year,Publication Month,Publication Day,Abstract,Authors\n"T, one",S,2001.0,2,3,"Some ""text""",A\nT2,S,,,,X,\n')
    r = readers.read(spark, "Csv", csv).orderBy("title").collect()
    assert [(x.title, x.publication_year, x.publication_date) for x in r] == [("T, one", 2001, "2001-02-03"), ("T2", 1973, "1973-01-01")] and r[0].abstract == 'Some "text"'
    tab = p("b.csv", "title\tsource\tpublication_year\tpublication_month\tpublication_day\tabstract\tauthors\nT\tS\t2000\t1\t1\tX\tA\n")
    assert readers.read(spark, "Csv", tab).first().publication_year == 2000
    wos = p("c.txt", "FN x\nVR 1.0\nPT J\nAF Doe, J\n   Roe, K\nTI A title\n   goes on\nAB Abstract\nPY 1999\nER\n\nPT J\nTI Second\nPY 2003\nER\nEF\n")
    w = readers.read(spark, "WOS", wos).orderBy("title").collect()
    assert [(x.title, x.publication_year, x.authors) for x in w] == [("A title goes on", 1999, "Doe, J Roe, K"), ("Second", 2003, None)]
    ris = p("d.ris", "TY  - JOUR\nAU  - A, B\nAU  - C, D\nTI  - Title\nAB  - Text\nPY  - 2005\nER  - \n")
    x = readers.read(spark, "RIS", ris).first()
    assert (x.title, x.authors, x.abstract, x.publication_year) == ("Title", "A, B; C, D", "Text", 2005)
    ira = p("e.txt", "**** *id_1 *year_2001\nHello world\n**** *id_2\nBye\n")
    assert sorted((r.marks["id"], r.text) for r in readers.read(spark, "Iramuteq", ira).collect()) == [("1", "Hello world"), ("2", "Bye")]
    lst = p("f.tsv", "status\tlabel\tforms\nmap\tcat\tcats|&|kitty\nstop\tthe\t\n")
    assert {(r.term, r.list, r.root) for r in readers.read(spark, "TermList", lst).collect()} == {("cat", "MapTerm", None), ("cats", "MapTerm", "cat"), ("kitty", "MapTerm", "cat"), ("the", "StopTerm", None)}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "2")
    assert sorted((r.entry, r.content) for r in readers.read(spark, "Archive", str(tmp_path / "z.zip")).collect()) == [("one.txt", "1"), ("two.txt", "2")]
    js = p("g.json", json.dumps({"documents": [{"document": {"hyperdata": {"title": "J", "publication_year": 2010}}, "ngrams": {"ngrams": ["a"], "hash": "h"}, "hash": "x"}], "garg_version": "1"}))
    assert readers.read(spark, "Json", js).first().title == "J"
    xml = p("h.xml", "<mediawiki><page><title>P</title><revision><text>'''Bold''' [[link|text]] {{tpl}}</text></revision></page></mediawiki>")
    assert readers.read(spark, "Wikimedia", xml).first().abstract == "Bold text"


def test_writers_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("T\t1", "S", 2001, 2, 3, 'say "x"\nnow', "A")], "title string, source string, publication_year int, publication_month int, publication_day int, abstract string, authors string")
    writers.write_csv(docs, str(tmp_path / "o"))
    r = readers.read(spark, "Csv", str(tmp_path / "o")).first()
    assert (r.title, r.abstract, r.publication_year) == ("T\t1", 'say "x"\nnow', 2001)
    nodes = spark.createDataFrame([(1, "a&b", 3)], "id int, label string, size int")
    edges = spark.createDataFrame([(1, 1, 0.5)], "src int, dst int, weight double")
    assert "a&amp;b" in writers.gexf(nodes, edges)
    rows = writers.corpus_rows(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, t string"), spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, term string"))
    assert writers.corpus_hash(rows) == writers.corpus_hash(rows.orderBy(F.desc("hash")))


def test_connector_pages(spark):
    fetch = lambda q, offset, size: [{"title": f"{q}{i}", "publication_year": 2000} for i in range(offset, min(offset + size, 450))]
    assert connectors.read_pages(spark, fetch, "q", service="pubmed", limit=430).count() == 430
    assert connectors.istex_query("cats") == 'language:"en" AND abstract:(cats)'


def test_registered_source(spark):
    from lexispark.sources import datasource

    datasource.register(spark)
    df = spark.read.format("lexispark_pages").options(fetch="lexispark.sources.datasource:sample_fetch", query="cats", service="pubmed", total="1000", limit="430").load()
    assert df.count() == 430 and df.where("title = 'cats 7'").first().publication_year == 2007


def test_stream_equals_batch(spark, sf, tmp_path):
    path = f"{sf}/events.parquet"
    events = spark.read.parquet(path)
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    s = ingest.stream_parquet(spark, str(tmp_path / "e"), events.schema)
    delta = F.when(F.col("event_type") == "error", -1).otherwise(1)
    live = ingest.run_to_table(ingest.live_deltas(s, "user_id", delta), "live")
    assert cells(live, "user_id", "total") == cells(ingest.live_deltas(events, "user_id", delta), "user_id", "total")
    seen = []
    q = ingest.ingest(ingest.stream_parquet(spark, str(tmp_path / "e"), events.schema), lambda df, k: seen.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(seen) == events.count() and len(seen) == 3
