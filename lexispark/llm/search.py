"""Exact top-k search by integer inner product: distributed histogram selection.

Each pass scores all candidates against a block of queries and counts, for every query, the
scores by bins of the interval that must hold its k-th value; sums of these histograms narrow the interval
until it is one value. A last pass keeps what reaches that value, each task no more than the k + 1 best
of its own, and a final ranking breaks ties by id. Scores are never stored. Queries are dealt with in
blocks of bounded size, so what is broadcast and summed doesn't grow with the data; a scan serves a whole block.

A query's own row is no candidate for it: one row of its id and vector, if there is one. Repeated ids, and repeated rows, are queries and
candidates of their own. Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an
id. Vectors are compared with vectors of the same length only; empty ones score 0 with each other.
Scores beyond 63 bits are held at the bounds of a long. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, arrow_rows, total_of

#: Queries in a block (of one scan), queries and candidates scored at once, bins in a histogram.
BLOCK, PART, CHUNK, BINS = 12_000, 1500, 512, 64
VECTOR_BATCH_ROWS = 4096
LONG = 2**63 - 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of an array column, as doubles (whole numbers)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256 * flat.reshape(len(column), dim))


def scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number inner products. Doubles hold them exactly where all sums are below 2**53."""
    if exact:
        return (queries @ rows.T).astype(np.int64)
    wide = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array([[int(x) for x in r] for r in rows], dtype=object).T
    return np.clip(wide, -LONG, LONG).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k best rows of vectors."""
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = usable(vectors)
    staged = Staged(usable(queries).groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "queries")
    asked = staged.df
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(256 * x).cast("double") * F.floor(256 * x).cast("double"))
    most = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    largest = {r["dim"]: (r["norm"], r["top"]) for r in rows.groupBy(F.size("v").alias("dim")).agg(F.max(norm).alias("norm"), F.max(most).alias("top")).collect()}
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim, n in sorted((r["dim"], r["n"]) for r in asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()):
        if dim not in largest:
            continue
        own, same = asked.where(F.size("v") == dim), rows.where(F.size("v") == dim)
        blocks = -(-n // BLOCK)
        for b in range(blocks):
            block = own.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b) if blocks > 1 else own
            got = sorted(block.collect(), key=lambda r: (r["vec_id"], r["v"]))  # BLOCK rows, about
            if got:
                q = np.floor(256 * np.array([r["v"] for r in got], dtype=np.float64).reshape(len(got), dim))
                out = out.unionByName(select_block(same, [r["vec_id"] for r in got], [r["copies"] for r in got], q, dim, largest[dim], k))
    staged.drop()
    return out


def itself(ids: np.ndarray, q: np.ndarray, vec: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many rows are each query's own: of its id and its whole numbers."""
    order = np.argsort(vec, kind="stable")
    low, high = np.searchsorted(vec[order], ids, side="left"), np.searchsorted(vec[order], ids, side="right")
    out = np.zeros(len(ids), dtype=np.int64)
    for i in np.flatnonzero(low < high):
        out[i] = (v[order[low[i] : high[i]]] == q[i]).all(axis=1).sum()
    return out


def select_block(rows: DataFrame, ids: list[int], copies: list[int], q: np.ndarray, dim: int, largest: tuple[float, float], k: int) -> DataFrame:
    spark = rows.sparkSession
    ids_, n = np.array(ids, dtype=np.int64), len(ids)
    reach = np.sqrt((q * q).sum(axis=1)) * np.sqrt(largest[0])
    top = max(256 * largest[1] + 1, np.abs(q).max(initial=0))
    exact = bool(top * top * dim < 2**53)
    bound = [min(LONG, int(x) + 2) for x in np.minimum(reach, 2.0**62)] if exact else [LONG] * n
    held = spark.sparkContext.broadcast((ids_, q))
    low, high = np.array([-x for x in bound], dtype=object), np.array(bound, dtype=object)  # the k-th value is in low..high
    above = np.zeros(n, dtype=np.int64)  # scores over high
    # a query's score with itself, and whether its own row is among the candidates
    mine, there = np.array([int(scores(q[i : i + 1], q[i : i + 1], exact)[0, 0]) for i in range(n)], dtype=object), np.zeros(n, dtype=bool)
    first = True
    while first or (low < high).any():
        width = np.array([-(-(int(h) - int(lo) + 1) // BINS) for lo, h in zip(low, high)], dtype=np.int64)
        hist, own = histograms(rows, held, low.astype(np.int64), high.astype(np.int64), width, dim, exact, first)
        there = own > 0 if first else there
        for i in range(n):
            if low[i] >= high[i] and not first:
                continue
            bins = hist[i]
            if there[i] and low[i] <= mine[i] <= high[i]:
                bins[(int(mine[i]) - int(low[i])) // int(width[i])] -= 1
            need = k - above[i]
            down = np.cumsum(bins[::-1])
            if down[-1] < need:  # fewer candidates than k: all of them
                high[i] = low[i]
                continue
            at = BINS - 1 - int(np.searchsorted(down, need))
            above[i] += bins[at + 1 :].sum()
            low[i], high[i] = int(low[i]) + at * int(width[i]), min(int(high[i]), int(low[i]) + (at + 1) * int(width[i]) - 1)
        first = False
    least = low.astype(np.int64)

    def make():
        ids_, q = held.value
        best: dict[int, list[tuple[int, int]]] = {}

        def step(batch):
            vec, v = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
            for p in range(0, n, PART):
                for a in range(0, len(vec), CHUNK):
                    s = scores(q[p : p + PART], v[a : a + CHUNK], exact)
                    i, j = np.nonzero(s >= least[p : p + PART, None])
                    if not len(i):
                        continue
                    x, w = s[i, j], vec[a + j]
                    order = np.lexsort((w, -x, i))
                    i, x, w = i[order], x[order], w[order]
                    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    front = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)])) <= k
                    fresh: dict[int, list[tuple[int, int]]] = {}
                    for c, y, z in zip((i[front] + p).tolist(), x[front].tolist(), w[front].tolist()):
                        fresh.setdefault(c, []).append((-y, z))
                    for c, new in fresh.items():
                        best[c] = sorted(best.get(c, []) + new)[: k + 1]

        def finish():
            out = [(c, int(ids_[c]), z, -y, bool(there[c] and z == ids_[c] and -y == mine[c]), copies[c]) for c, own in best.items() for y, z in own]
            return dict(zip(("q", "query_id", "vec_id", "score", "own", "copies"), map(list, zip(*out)))) if out else None

        step.finish = finish
        return step

    kept = arrow_rows(rows, make, "q long, query_id long, vec_id long, score long, own boolean, copies long", VECTOR_BATCH_ROWS)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    gone = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))  # the first of these is the query's own row
    ranked = kept.withColumn("place", F.row_number().over(order)).withColumn("gone", gone).where(~(F.col("own") & (F.col("gone") == 1)))
    ranked = ranked.withColumn("rank", (F.col("place") - F.least("gone", F.lit(1))).cast("int")).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def histograms(rows: DataFrame, held, low: np.ndarray, high: np.ndarray, width: np.ndarray, dim: int, exact: bool, count_own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each query (by place) the counts of its scores in low..high by bins, and how many rows are its own if asked for. Sums of BLOCK x BINS numbers come back."""
    n = len(low)

    def make():
        ids_, q = held.value
        total, own = np.zeros(n * BINS, dtype=np.int64), np.zeros(n, dtype=np.int64)

        def step(batch):
            vec, v = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
            if count_own:
                np.add(own, itself(ids_, q, vec, v), out=own)
            for p in range(0, n, PART):
                part = slice(p, p + PART)
                view = total[p * BINS : (p + PART) * BINS]
                for a in range(0, len(vec), CHUNK):
                    s = scores(q[part], v[a : a + CHUNK], exact)
                    i, j = np.nonzero((s >= low[part, None]) & (s <= high[part, None]))
                    # as unsigned numbers, since the interval can be longer than half the range of a long
                    bins = (s[i, j].astype(np.uint64) - low[part][i].astype(np.uint64)) // width[part][i].astype(np.uint64)
                    np.add(view, np.bincount(i * BINS + bins.astype(np.int64), minlength=len(view)), out=view)

        def finish():
            keys = range(0, n, PART)
            return {"key": [p // PART for p in keys], "data": [np.concatenate([total[p * BINS : (p + PART) * BINS], own[p : p + PART]]).tobytes() for p in keys]}

        step.finish = finish
        return step

    sums = total_of(arrow_rows(rows, make, "key long, data binary", VECTOR_BATCH_ROWS), "<i8")
    hist, own = np.zeros((n, BINS), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for key, x in sums.items():
        size = len(x) // (BINS + 1)
        hist[key * PART : key * PART + size], own[key * PART : key * PART + size] = x[: size * BINS].reshape(size, BINS), x[size * BINS :]
    return hist, own
