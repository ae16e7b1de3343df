"""Every registered query of the engine's own operators against its SQL, or against a plain version where SQL can't state it, over whole tables."""

import decimal
import glob
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexispark.functions import stem as stems
from lexispark.operators import extraction
from lexispark.plans import adapters, catalogue

WORD = re.compile(r"[,.:;?!(){}\[\]\"'\s]+")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def words(text):
    return [w for w in WORD.split((text or "").lower()) if w]


def documents(duck):
    return duck.sql("select doc_id, lang, text from documents").fetchall()


def kernel_edges(spark, sf):
    return [(r.src, r.dst, r.weight) for r in catalogue._link_edges(spark, sf, adapters.KERNEL_TERMS).collect()]


def brute_stemmed(spark, sf, duck):
    wanted = {stems.stem(w, "en") for w in ("the", "things", "with")}
    return {(d,) for d, lang, text in documents(duck) if wanted <= {stems.stem(w, lang) for w in words(text)}}


def brute_by_stem(spark, sf, duck):
    forms = defaultdict(Counter)
    for _, lang, text in documents(duck):
        for w in words(text):
            forms[lang, stems.stem(w, lang)][w] += 1
    return {(min(c, key=lambda w: (-c[w], w)), lang, sum(c.values()), stem) for (lang, stem), c in forms.items()}


def brute_segments(spark, sf, duck):
    counts = extraction.ngram_counts(spark.read.parquet(f"{sf}/documents.parquet").select("text"), 3)
    many = {tuple(r.gram) for r in counts.where("n >= 2").select("gram").collect()}
    score = {tuple(r.gram): r.autonomy for r in extraction.autonomy(counts, 3).collect() if tuple(r.gram) in many}
    return {(d, n, t) for d, _, text in documents(duck) for t, n in Counter(extraction.segment(words(text), score, 3)).items()}


def brute_cliques(spark, sf, duck):
    near = defaultdict(set)
    for a, b, _ in kernel_edges(spark, sf):
        near[a].add(b)
        near[b].add(a)
    out = set()

    def grow(r, p, x):
        if not p and not x:
            out.add((" ".join(sorted(r)),))
        for v in sorted(p):
            grow(r | {v}, p & near[v], x & near[v])
            p, x = p - {v}, x | {v}

    grow(set(), set(near), set())
    return out


def brute_communities(spark, sf, duck):
    near = defaultdict(list)
    for a, b, w in kernel_edges(spark, sf):
        near[a].append((b, w))
        near[b].append((a, w))
    label = {v: v for v in near}
    for _ in range(10):
        new = {}
        for v, own in near.items():
            votes = defaultdict(float)
            for u, w in own:
                votes[label[u]] += w
            votes = {k: round(x, 9) for k, x in votes.items()}
            votes[label[v]] = votes.get(label[v], 0.0) + 1e-6
            new[v] = min(votes, key=lambda k: (-votes[k], k))
        if new == label:
            break
        label = new
    return {(c, v) for v, c in label.items()}


def brute_components_of_vectors(spark, sf, duck):
    import numpy as np

    rows = duck.sql("select vec_id, embedding from embeddings").fetchall()
    x = np.array([v for _, v in rows], dtype=float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    p = np.abs(x @ axes[:2].T)
    return {(round(a, 3), round(b, 3), i) for (i, _), (a, b) in zip(rows, p.tolist())}


def brute_phylo_groups(spark, sf, duck):
    """Cliques of the kernel's terms by period of six years, nested ones left out, from plain counts."""
    texts = documents(duck)
    df = Counter(w for _, _, t in texts for w in set(words(t)))
    kernel = set(sorted(df, key=lambda w: (-df[w], w))[: adapters.KERNEL_TERMS])
    least, out = len(texts) // 15, set()
    for first in range(1990, 2015, 6):
        baskets = [set(words(t)) & kernel for d, _, t in texts if first <= 1990 + d % 30 <= first + 5]
        pairs = Counter((a, b) for s in baskets for a in s for b in s if a < b)
        near = defaultdict(set)
        for (a, b), n in pairs.items():
            if n > least:
                near[a].add(b)
                near[b].add(a)
        found = []

        def grow(r, p, x):
            if not p and not x:
                found.append((sorted(r), sum(r <= s for s in baskets)))
                return
            pivot = max(p | x, key=lambda v: len(near[v] & p))
            for v in sorted(p - near[pivot]):
                grow(r | {v}, p & near[v], x & near[v])
                p, x = p - {v}, x | {v}

        grow(set(), set(near), set())
        kept = [(c, n) for c, n in found if len(c) >= 3]
        limit = min(1, max((n for _, n in kept), default=0))
        kept = sorted((c, n) for c, n in kept if n >= limit)
        out |= {(first, f"{first}-1-{k}", first + 5, " ".join(c), n) for k, (c, n) in enumerate(kept)}
    return out


#: Plain versions of queries without SQL: rows as sets of tuples in the order of the sorted columns.
BRUTE = {
    "fulltext_stemmed": brute_stemmed, "occurrences_by_stem": brute_by_stem, "segment_terms": brute_segments, "maximal_cliques": brute_cliques,
    "communities": brute_communities, "embedding_components": brute_components_of_vectors, "phylo_groups": brute_phylo_groups,
}


def check_branches(rows, spark, sf):
    """Branches of the temporal groups: each group is in one; births and ages are those of its groups' periods."""
    groups = {r.id: r for r in catalogue.QUERIES["phylo_groups"](spark, sf).collect()}
    assert rows and sum(r.n_groups for r in rows) == len(groups) and len({r.threshold for r in rows}) == 1
    starts = {g["first"] for g in groups.values()}
    for r in rows:
        assert r.branch in groups and r.birth in starts and 1 <= r.size <= r.n_groups and r.age >= 5 and r.birth <= groups[r.branch]["first"] <= r.birth + r.age


def check_graph(rows, spark, sf):
    """Kept links are among those of the similarity, and all links inside communities are kept."""
    from lexispark.operators import graph, similarity

    cooc = adapters.map_cooc(spark, sf, adapters.KERNEL_TERMS).where("n > 1 OR x = y")
    cells = similarity.similarity_links(cooc, threshold=0.02).collect()
    all_links = {(r.x, r.y): round(r.value, 6) for r in cells}
    label = {r.node: r.community for r in graph.communities(spark.createDataFrame([(a, b, w) for (a, b), w in ((k, r.value) for k, r in (((r.x, r.y), r) for r in cells))], "src string, dst string, weight double")).collect()}
    kept = {(r.src, r.dst): r.weight for r in rows}
    assert kept and all(math.isclose(all_links[k], w, abs_tol=2e-6) for k, w in kept.items())
    assert {k for k in all_links if label[k[0]] == label[k[1]]} <= set(kept)


#: Queries whose result isn't one set of rows, as it rests on a library's search; their properties are checked.
PROPERTIES = {"phylo_branches": check_branches, "term_communities_graph": check_graph}


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = df.collect()
    if name in PROPERTIES:
        return PROPERTIES[name](rows, spark, sf)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert got, "a query without rows shows nothing"
    if name in BRUTE:
        if name == "embedding_components":  # directions are known up to their sign
            got = [(round(abs(a), 3), round(abs(b), 3), i) for a, b, i in got]
        want = BRUTE[name](spark, sf, duck)
        if name == "embedding_components":
            got, want = sorted(got, key=lambda r: r[2]), sorted(want, key=lambda r: r[2])
            assert all(abs(x - y) < 0.01 for p, q in zip(got, want) for x, y in zip(p, q))
        else:
            assert len(got) == len(set(got)) and set(got) == want
        return None
    out = duck.sql(catalogue.ORACLES[name])
    names, rows = list(out.columns), out.fetchall()
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)
    assert len(got) == len(want)
    assert got == want
    return None


def test_flagship_is_registered():
    assert catalogue.FLAGSHIP in catalogue.QUERIES
    assert set(catalogue.ORACLES) | set(BRUTE) | set(PROPERTIES) == set(catalogue.QUERIES)


def test_operators_of_lists_agree(spark, sf):
    """The square tables of a bounded list against pairs made row by row, with and without groups."""
    from lexispark.operators import occurrences as occ

    rows = adapters.row_terms(spark, sf)
    lists = occ.top_terms(occ.row_frequency(rows, ("lang",)), 40, ("lang",)).select("lang", "term")
    each = rows.select("lang", "doc_id", F.explode("terms").alias("term")).join(lists, ["lang", "term"], "left_semi")
    for diagonal in (True, False):
        want = set(occ.cooccurrence(each, by=("lang",), diagonal=diagonal).collect())
        assert {tuple(r) for r in want} == {tuple(r) for r in occ.list_cooccurrence(rows, lists, "lang", diagonal=diagonal).select("lang", "x", "y", "n").collect()}
    old, occ.SQUARE = occ.SQUARE, 10
    try:
        assert {tuple(r) for r in occ.list_cooccurrence(rows, lists, "lang").select("lang", "x", "y", "n").collect()} == {tuple(r) for r in occ.cooccurrence(each, by=("lang",)).collect()}
    finally:
        occ.SQUARE = old
