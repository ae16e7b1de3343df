"""Decontamination against a brute force over all documents and items: recall by share of words reworded, short items, parts of a benchmark."""

import random

import pytest

from lexispark.llm import decontaminate
from lexispark.llm.decontaminate import lcs, masks_of, words_of


def natural(r, size=4000):
    """A vocabulary with frequencies that fall as in texts, and a drawer of words."""
    words = sorted({"".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(size)})
    weights = [1 / (k + 3) for k in range(len(words))]
    return lambda n: r.choices(words, weights, k=n)


def planted(r, draw, items, n_docs, rate):
    """Documents, half of which hold an item with this share of its words replaced, cut out or swapped."""
    rows = []
    for d in range(n_docs):
        w = draw(r.choice([60, 200, 700]))
        if d % 2 == 0:
            own = r.choice(items)[1].split()
            for k in range(len(own)):
                if r.random() < rate:
                    own[k] = r.choice([draw(1)[0], "", " ".join(draw(2))])
            at = r.randrange(len(w))
            w[at:at] = own
        rows.append((d, " ".join(w)))
    return rows


def brute(rows, items, least_lcs=0.6, least_answer=0.5):
    """Pairs whose item, and its answer, are mostly subsequences of some stretch of the item's length and a half."""
    out = set()
    for d, text in rows:
        w = words_of(text)
        for i, t in items:
            own = words_of(t)
            tail = own[-max(3, len(own) // 4) :]
            known, size = set(own), len(own) + len(own) // 2
            for a in range(0, max(1, len(w) - size + 4), 4):
                region = w[a : a + size]
                if sum(x in known for x in region) < least_lcs * len(own):
                    continue
                if lcs(masks_of(own), len(own), region) >= least_lcs * len(own) and lcs(masks_of(tail), len(tail), region) >= least_answer * len(tail):
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2, 0.3])
def test_recall_by_share_of_words_reworded(spark, rate):
    r = random.Random(int(100 * rate) + 3)
    draw = natural(r)
    items = [(i, " ".join(draw(r.randint(20, 59)))) for i in range(60)]
    rows = planted(r, draw, items, 200, rate)
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    want = brute(rows, items)
    assert len(want) >= (95 if rate < 0.3 else 70)
    recall = len(got & want) / len(want)
    print(f"rate {rate}: {len(want)} pairs by brute force, recall {recall:.3f}, others found {len(got - want)}")
    assert recall >= (1.0 if rate == 0 else 0.9)
    assert len(got - want) <= 0.05 * len(got)


def test_short_items_match_word_by_word(spark):
    items = [(1, "Blue whale"), (2, "zeppelin"), (3, "one two three four"), (4, "one two three four"), (5, "two"), (6, "-- , --")]
    rows = [(1, "a blue, WHALE swims"), (2, "whale blue"), (3, "the zeppelins and a Zeppelin!"), (4, "x one two three four y"), (5, "one two three"), (6, ""), (7, None), (8, "blue"), (9, "whale")]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(x.doc_id, x.item_id, x.cosine, x.lcs_ratio) for x in found.collect()]
    assert sorted(x[:2] for x in got) == [(1, 1), (3, 2), (4, 3), (4, 4), (4, 5), (5, 5)]
    assert all(x[2:] == (None, 1.0) for x in got)


def test_a_benchmark_in_parts_finds_the_same(spark):
    r = random.Random(8)
    draw = natural(r)
    items = [(i, " ".join(draw(r.randint(20, 59)))) for i in range(50)]
    rows = planted(r, draw, items, 100, 0.0)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    want = brute(rows, items)
    for size in (16 << 20, 4000, 900):
        got = [(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, part_bytes=size).collect()]
        assert len(got) == len(set(got)) and set(got) >= want and len(set(got) - want) <= 5


def test_clashing_columns_and_rows_without_ids(spark):
    docs = spark.createDataFrame([(1, "nothing here", 1, 2), (None, "alpha beta gamma delta epsilon zeta eta theta", 1, 2), (3, "alpha beta gamma delta epsilon zeta eta theta", 1, 2)], "doc_id long, text string, ids int, cosine int")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta", 5), (None, "alpha beta gamma delta epsilon zeta eta theta", 5)], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(None, 1), (None, None), (3, 1), (3, None)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(str(x.doc_id) for x in kept.collect()) == ["1", "None"]
