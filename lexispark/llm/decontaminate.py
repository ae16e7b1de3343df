"""Benchmark decontamination by latent semantic retrieval.

Words that occur in the benchmark are the terms; documents are read once into term numbers,
which wait in the shared folder. TF-IDF passages of all documents, and the benchmark's items,
get a randomised singular value decomposition: each task multiplies its passages with a
random matrix and back, sums are made by rows of terms, and only matrices of terms by rank
reach the driver. Overlapping windows of two lengths at a stride of twelve words are then compared with all
items by cosine in the latent space. What passes is checked by the longest common subsequence
of the item's words with the words around the window, and by the item's answer (its last
quarter) on its own, so that paraphrases with some words changed are found and chance likeness isn't.
Items most of whose words are too frequent for the latent space are compared, by the same two checks, with every
stretch of the documents that holds enough of their words, whatever its cosine; their cosine is null where only this finds them.
Items of fewer than `min_words` words can't be reworded and told from chance: they match where their words stand in a row.

Nulls: a null text counts as empty; items without words match nothing. Empty tables give no rows. A repeated item matches once
for each. Extra columns are ignored.
Size: what is broadcast grows with the benchmark, never with the documents. Items are sparse rows; a benchmark of more than
`part_bytes` of text is searched in parts of about that size, each with its own latent space, so any benchmark can be given whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, arrow_rows, total_of, without_ids

#: ASCII letters in lower case, ASCII punctuation and controls as spaces; other bytes as they are.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
STRIDE, PASSAGE = 12, 24
ROWS_A_KEY = 256
#: Windows and items that one matrix product compares.
WINDOWS, ITEMS = 4096, 1024


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def lcs(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a pattern of n words (its places by word, as bits) and a list of words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def padded(batch_column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers of all documents in a row, each filled up to whole strides and three empty ones; first word and length of each."""
    gap = np.full(4 * STRIDE, -1, dtype=np.int32)
    parts, firsts, lengths, at = [], [], [], 0
    for x in batch_column:
        ids = np.frombuffer(x.as_buffer(), dtype=np.int32) if x.is_valid else gap[:0]
        fill = gap[: -len(ids) % STRIDE + 3 * STRIDE]
        parts += [ids, fill]
        firsts.append(at)
        lengths.append(len(ids))
        at += len(ids) + len(fill)
    return (np.concatenate(parts) if parts else gap[:0]), np.array(firsts, dtype=np.int64), np.array(lengths, dtype=np.int64)


def sums_by(ids: np.ndarray, size: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of rows[id] by runs of `size` words: (places with a term, their runs, the runs that have any, their sums)."""
    at = np.flatnonzero(ids >= 0)
    run = at // size
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(at) else np.empty(0, dtype=np.int64)
    if not len(at):
        return at, run, run, np.zeros((0, rows.shape[1]), dtype=rows.dtype)
    return at, run, run[starts], np.add.reduceat(rows[ids[at]], starts, axis=0)


def by_rows(z: np.ndarray) -> dict:
    """A matrix as rows (key, data) of a block of its rows each."""
    keys = range(0, len(z), ROWS_A_KEY)
    return {"key": [k // ROWS_A_KEY for k in keys], "data": [np.ascontiguousarray(z[k : k + ROWS_A_KEY]).tobytes() for k in keys]}


def joined(sums: dict[int, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for k, x in sums.items():
        out[k * ROWS_A_KEY : (k + 1) * ROWS_A_KEY] = x.reshape(-1, shape[1])
    return out


@dataclass
class Items:
    """A part of the benchmark. Sparse rows: the distinct terms (ascending) of item i, and how often it has them, are those from first[i] to first[i + 1]."""

    names: list
    words: list[np.ndarray]  # term numbers in order
    first: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    item: np.ndarray  # the item of each place in terms

    @staticmethod
    def of(items: list[tuple], vocabulary: dict[bytes, int]) -> Items:
        words = [np.array([vocabulary[w] for w in ws], dtype=np.int32) for _, ws in items]
        own = [np.unique(x, return_counts=True) for x in words]
        sizes = [len(t) for t, _ in own]
        return Items([i for i, _ in items], words, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([t for t, _ in own]), np.concatenate([c for _, c in own]), np.repeat(np.arange(len(own)), sizes))

    def times(self, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The matrix of items by terms, weighted, times `right`."""
        return np.add.reduceat((self.counts * weights[self.terms])[:, None] * right[self.terms], self.first[:-1], axis=0)

    def back(self, weights: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
        """Adds the transposed matrix times y to out."""
        np.add.at(out, self.terms, (self.counts * weights[self.terms])[:, None] * y[self.item])


def phrases_in(ids: np.ndarray, phrases: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, items) where short items stand word by word. phrases: by length, their numbers and rows of terms, ordered by their mixed numbers."""
    places, items = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for length, (who, rows) in phrases.items():
        if len(ids) < length:
            continue
        runs = np.lib.stride_tricks.sliding_window_view(ids, length)
        own, key = mixed(rows), mixed(runs)
        low, high = np.searchsorted(own, key, side="left"), np.searchsorted(own, key, side="right")
        for shift in range(int((high - low).max(initial=0))):  # equal phrases, or ones whose mixed numbers agree
            at = np.flatnonzero(low + shift < high)
            at = at[(runs[at] == rows[low[at] + shift]).all(axis=1)]
            places.append(at)
            items.append(who[low[at] + shift])
    return np.concatenate(places), np.concatenate(items)


def mixed(rows: np.ndarray) -> np.ndarray:
    """One number for each row of terms; equal rows have equal numbers."""
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (rows[:, k].astype(np.int64) + 1).astype(np.uint64)
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rank: int = 48,
    oversample: int = 8,
    least_cosine: float = 0.62,
    least_lcs: float = 0.6,
    least_answer: float = 0.5,
    max_share: float = 0.01,
    least_shared: float = 0.35,
    least_weighted: float = 0.5,
    min_words: int = 5,
    part_bytes: int = 16 << 20,
    seed: int = 11,
) -> DataFrame:
    """doc_id, item_id, cosine, lcs_ratio, answer_ratio: one row for each document and item that it holds, copied or reworded."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs_ratio double, answer_ratio double"
    params = (rank, oversample, least_cosine, least_lcs, least_answer, max_share, least_shared, least_weighted, min_words, seed)
    texts = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    parts = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)
    found = None
    for p in range(parts):
        own = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else texts
        items = [(r["item_id"], w) for r in own.collect() if (w := words_of(r["text"]))]  # part_bytes, about
        if items:
            part = leaks_of(docs, items, schema, *params)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def leaks_of(docs: DataFrame, listed: list[tuple], schema: str, rank, oversample, least_cosine, least_lcs, least_answer, max_share, least_shared, least_weighted, min_words, seed) -> DataFrame:
    """find_leaks for a part of the benchmark: (item_id, words). The result waits in the shared folder."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in listed for w in ws}))}
    items, n = Items.of(listed, vocabulary), len(vocabulary)
    held_words = spark.sparkContext.broadcast(vocabulary)

    def read():
        get = held_words.value.get

        def step(batch):
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                out.append(np.fromiter(map(get, words, repeat(-1)), dtype=np.int32, count=len(words)).tobytes())
            return {"doc_id": batch.column(0), "ids": out}

        return step

    terms = Staged(arrow_rows(docs.select("doc_id", "text"), read, f"doc_id {kind}, ids binary"), "terms")
    staged = terms.df

    def passages():  # number of passages with each term, and of all passages
        df = np.zeros(n + 1, dtype=np.int64)

        def step(batch):
            ids, _, lengths = padded(batch.column(0))
            at = np.flatnonzero(ids >= 0)
            pairs = np.unique(at // PASSAGE * n + ids[at])
            np.add(df[:n], np.bincount(pairs % n, minlength=n), out=df[:n])
            df[n] += int((-(-lengths // PASSAGE)).sum())

        step.finish = lambda: {"key": [0], "data": [df.tobytes()]}
        return step

    df = total_of(arrow_rows(staged.select("ids"), passages, "key long, data binary"), "<i8").get(0, np.zeros(n + 1, dtype=np.int64))
    total = int(df[n]) + 1
    # words of very many passages carry no sense here; they count in the subsequence checks alone. Three quarters of the terms stay in any case
    most = max(20, max_share * total, float(np.quantile(df[:n], 0.75)))
    idf = np.where(df[:n] <= most, np.log((1 + total) / (1 + df[:n])) ** 2, 0.0)
    short = np.array([len(x) < min_words for x in items.words])
    # copies around an item make its own words frequent: items with too few words of weight are searched word by word
    plain = [i for i, x in enumerate(items.words) if not short[i] and (idf[x] > 0).mean() < least_weighted]
    size = min(rank + oversample, n)

    def sketch(right: np.ndarray, back: bool) -> np.ndarray:
        """A'(A R) if back, else (A R)'(A R), for the passages' matrix A of all documents and items."""
        weighted = (idf[:, None] * right).astype(np.float32)
        held = spark.sparkContext.broadcast(weighted)
        useful = idf > 0

        def make():
            w = held.value
            z = np.zeros((n if back else size, size))

            def step(batch):
                ids, _, _ = padded(batch.column(0))
                ids = np.where((ids >= 0) & useful[ids], ids, -1)
                at, run, runs, y = sums_by(ids, PASSAGE, w)
                if not len(at):
                    return
                if not back:
                    np.add(z, y.T.astype(np.float64) @ y, out=z)
                    return
                order = np.argsort(ids[at], kind="stable")
                terms = ids[at][order]
                starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
                z[terms[starts]] += np.add.reduceat(y[np.searchsorted(runs, run[order])], starts, axis=0)

            step.finish = lambda: by_rows(z)
            return step

        got = joined(total_of(arrow_rows(staged.select("ids"), make, "key long, data binary"), "<f8"), (n if back else size, size))
        y = items.times(idf, right)
        if not back:
            return got + y.T @ y
        got *= idf[:, None]
        items.back(idf, y, got)
        return got

    q, _ = np.linalg.qr(sketch(np.random.default_rng(seed).standard_normal((n, size)), True))
    values, rotation = np.linalg.eigh(sketch(q, False))
    top = [k for k in np.argsort(-values)[:rank] if values[k] > 1e-9 * values.max()]
    # right singular vectors (terms x rank) over their singular values: no direction, such as that of a language, outweighs the others
    basis = q @ rotation[:, top] / np.sqrt(values[top])
    latent = items.times(idf, basis)
    latent[short] = 0
    norms = np.linalg.norm(latent, axis=1)
    item_latent = (latent / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
    held = spark.sparkContext.broadcast(((idf[:, None] * basis).astype(np.float32), item_latent, items, idf, plain))

    def search():
        w, item_latent, items, weight, plain = held.value
        useful, item_words = weight > 0, items.words
        # what an item's terms weigh: a window must hold a good part of what it has room for
        keys = items.item.astype(np.int64) * n + items.terms
        item_weight = np.add.reduceat(weight[items.terms], items.first[:-1])
        item_length = np.array([len(x) for x in item_words])
        masks: dict[int, tuple] = {}  # of the items met
        phrases = {}
        for length in range(1, min_words):
            who = np.array([i for i, x in enumerate(item_words) if len(x) == length], dtype=np.int64)
            if len(who):
                rows = np.stack([item_words[i] for i in who])
                order = np.argsort(mixed(rows), kind="stable")
                phrases[length] = who[order], rows[order]
        look = np.full(n + 1, -1, dtype=np.int32)  # of a term, its place among an item's; the last is that of no term

        def likeness(item, region):
            """Ratios of the item and of its answer in a list of words, or None where either is too small."""
            if item not in masks:
                x = item_words[item].tolist()
                tail = x[-max(3, len(x) // 4) :]
                masks[item] = (masks_of(x), len(x)), (masks_of(tail), len(tail))
            whole, answer = masks[item]
            ratio = lcs(*whole, region) / whole[1]
            if ratio < least_lcs:
                return None
            answer = lcs(*answer, region) / answer[1]
            return (ratio, answer) if answer >= least_answer else None

        def by_words(ids, firsts, lengths):
            """(document, item): the best ratios of the items in `plain`. Regions are so long, and so near, that any stretch of an item's length and 48 words more lies in one."""
            out: dict[tuple[int, int], tuple[float, float]] = {}
            for item in plain:
                reach = len(item_words[item])
                own_terms, often = items.terms[items.first[item] : items.first[item + 1]], items.counts[items.first[item] : items.first[item + 1]]
                look[own_terms] = np.arange(len(own_terms))
                places = look[ids]
                look[own_terms] = -1
                have = np.r_[0, np.cumsum(places >= 0)]
                regions = np.maximum(1, -(-np.maximum(0, lengths - 4 * STRIDE - reach) // reach))
                docs = np.repeat(np.arange(len(firsts)), regions)
                a = firsts[docs] + (np.arange(len(docs)) - np.repeat(np.cumsum(regions) - regions, regions)) * reach
                b = np.minimum(a + 2 * reach + 4 * STRIDE, firsts[docs] + lengths[docs])
                # no subsequence is longer than the number of the item's words in the region, each as often as the item has it
                least = least_lcs * reach - 1e-9
                enough = np.flatnonzero(have[b] - have[a] >= least)
                kept = [enough[:0]]
                step = max(1, 2_000_000 // (2 * reach + 4 * STRIDE))
                for at in range(0, len(enough), step):
                    own = enough[at : at + step]
                    inside = a[own, None] + np.arange(2 * reach + 4 * STRIDE)
                    held_places = np.where(inside < b[own, None], places[np.minimum(inside, len(ids) - 1)], -1)
                    row, column = np.nonzero(held_places >= 0)
                    each = np.bincount(row * len(often) + held_places[row, column], minlength=len(own) * len(often)).reshape(len(own), -1)
                    kept.append(own[np.minimum(each, often).sum(axis=1) >= least])
                enough = np.concatenate(kept)
                for doc, x, y in zip(docs[enough].tolist(), a[enough].tolist(), b[enough].tolist()):
                    both = likeness(item, ids[x:y].tolist())
                    if both and both > out.get((doc, item), (0.0, 0.0)):
                        out[doc, item] = both
            return out

        def step(batch):
            ids, firsts, lengths = padded(batch.column(1))
            strides = len(ids) // STRIDE
            sums = np.zeros((strides + 4, w.shape[1]), dtype=np.float32)
            _, _, runs, y = sums_by(np.where((ids >= 0) & useful[ids], ids, -1), STRIDE, w)
            sums[runs] = y
            two = sums[:-1] + sums[1:]
            four = two[:-2] + two[2:]
            found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for z, span in ((two[:strides], 2), (four[:strides], 4)):
                norm = np.linalg.norm(z, axis=1)
                live = np.flatnonzero(norm > 1e-6)
                for k in range(0, len(live), WINDOWS):
                    own = live[k : k + WINDOWS]
                    unit = z[own] / norm[own, None]
                    for first in range(0, len(item_latent), ITEMS):
                        cos = unit @ item_latent[first : first + ITEMS].T
                        r, c = np.nonzero(cos >= least_cosine)
                        if not len(r):
                            continue
                        x, c = cos[r, c], c + first
                        inside = ids[np.minimum(own[r][:, None] * STRIDE + np.arange(span * STRIDE), len(ids) - 1)]
                        wanted = c[:, None] * n + inside
                        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                        shared = np.where((keys[at] == wanted) & (inside >= 0), weight[inside], 0.0).sum(axis=1)
                        room = np.minimum(1, span * STRIDE / item_length[c])
                        fits = shared >= least_shared * room * item_weight[c]
                        for place, item, cosine in zip(own[r[fits]].tolist(), c[fits].tolist(), x[fits].tolist()):
                            doc = int(np.searchsorted(firsts, place * STRIDE, side="right")) - 1
                            found.setdefault((doc, item), []).append((cosine, place * STRIDE, (place + span) * STRIDE))
            out: list[list] = [[], [], [], [], []]
            plainly = by_words(ids, firsts, lengths)
            at, who = phrases_in(ids, phrases)
            for doc, item in set(zip((np.searchsorted(firsts, at, side="right") - 1).tolist(), who.tolist())):
                plainly[doc, item] = (1.0, 1.0)
            doc_ids = batch.column(0).to_pylist() if found or plainly else []
            for (doc, item), spans in found.items():
                best = (0.0, 0.0, 0.0)
                reach = len(item_words[item])
                low, high = int(firsts[doc]), int(firsts[doc] + lengths[doc])
                last = (-1, -1)
                for x, start, end in sorted(spans, key=lambda s: s[1:]):
                    a, b = max(low, start - reach), min(high, end + reach)
                    if last[0] <= a and b <= last[1]:
                        best = (best[0], best[1], max(best[2], x)) if best[0] else best
                        continue
                    last = (a, b)
                    region = ids[a:b].tolist()
                    both = likeness(item, region)
                    if both and both[0] > best[0]:
                        best = (*both, x)
                if best[0]:
                    plainly.pop((doc, item), None)
                    for column, x in zip(out, (doc_ids[doc], items.names[item], best[2], best[0], best[1])):
                        column.append(x)
            for (doc, item), (ratio, answer) in plainly.items():
                for column, x in zip(out, (doc_ids[doc], items.names[item], None, ratio, answer)):
                    column.append(x)
            return dict(zip(("doc_id", "item_id", "cosine", "lcs_ratio", "answer_ratio"), out))

        return step

    out = Staged(arrow_rows(staged, search, schema), "leaks")  # a row a leak
    terms.drop()
    return out.df


def without_leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without the rows that hold an item. Rows without an id stay."""
    return without_ids(docs, find_leaks(docs, benchmark, **params), "leaks")
