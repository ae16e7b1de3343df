"""Near duplicates by n-gram Jaccard: a blocked sparse product of documents by shingles.

The product A A' of the document by shingle incidence is never formed whole. (1) One scan gives each
document's set size and a digest of its set, so that copies become one row of A, and a
fixed-size sketch of how many documents hold each shingle. (2) Only the columns of each row's prefix are
kept: shingles ordered from rare to common by the sketch, the first n - ceil(t n) + 1 of n, of which any
linked pair must share one. They are dealt out in blocks of columns; columns with one row can't add to a
product and are dropped there. (3) Overlap counts accumulate over columns for pairs of rows, and pairs whose sizes differ too much, or whose
count falls below what their sizes demand of the prefixes, are discarded. (4) What is left is decided by whole sets.

Groups of near copies don't become all their pairs. (3) and (4) run first for each row with
the hubs (smallest ids) of its columns alone; rows linked with a hub make its group, and links join groups into
components. The second, complete run does (3) for groups of different components: their shared columns are counted, and
pairs of single rows are held against the bound from their sizes. Hubs of what is left are decided by whole sets, and as 1 - Jaccard is a metric, members can be linked only if their
distances from their hubs make up for what the hubs' distance exceeds the threshold by; only
such members are compared. No link between different components is lost, so components are exact.

Nulls: a null text has no words, an empty set and no links; rows with a null doc_id get a null component. Texts of fewer words than n are
one shingle. Ids must be whole numbers (they are cast to long). Repeated ids are one node. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, arrow_rows, count_of, total_of, without_ids

#: Counters of the sketch, as a power of two; its size doesn't depend on the data.
SKETCH_BITS = 19
#: Postings that one block of columns holds, about, and how many a task gathers before it hands them on.
BLOCK_POSTINGS, GATHERED = 400_000, 400_000
#: Pairs that may be broadcast (two numbers each); more are joined by shuffles.
SMALL = 500_000
#: Rows of a column beyond which it is dealt out by rows as well.
HOT_COLUMN = 50_000

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles. Words are parted by ASCII white space; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(n, len(h))
    a = h[: len(h) - size + 1] * M1 + np.uint64(size)
    for k in range(1, size):
        a = (a ^ (a >> np.uint64(29))) * M2 + h[k : len(h) - size + 1 + k]
    a ^= a >> np.uint64(31)
    a *= M1
    a ^= a >> np.uint64(32)
    return np.unique(a)


def needed(na, nb, percent: int):
    """The least overlap of linked sets of these sizes: 100 i >= percent (na + nb - i)."""
    return -((-percent * (na + nb)) // (100 + percent))


def prefix_size(n, percent: int):
    """Elements of a set of which a linked set must share one."""
    return n - (-((-percent * n) // 100)) + 1


def index_size(n, percent: int):
    """Elements of a set of which a linked set, not smaller than it, must share one."""
    return n - needed(n, n, percent) + 1


def digests(docs: DataFrame, n: int) -> Staged:
    """Rows (doc_id, n, c1, c2) of documents, and rows (key, data) of the sketch, in one scan."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        seen: set[bytes] = set()

        def step(batch):
            sizes, c1, c2 = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_hashes(text, n)
                d = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                c1.append(int.from_bytes(d[:8], "little", signed=True))
                c2.append(int.from_bytes(d[8:], "little", signed=True))
                if len(s) and d not in seen:  # copies within a task count once
                    seen.add(d)
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(batch))
            return {"doc_id": batch.column(0), "n": sizes, "c1": c1, "c2": c2, "key": none.cast(pa.int64()), "data": none.cast(pa.binary())}

        def finish():
            if not seen:
                return None
            part = 1 << 15
            keys = list(range(len(sketch) // part))
            none = [None] * len(keys)
            return {"doc_id": none, "n": none, "c1": none, "c2": none, "key": keys, "data": [sketch[k * part : (k + 1) * part].tobytes() for k in keys]}

        step.finish = finish
        return step

    return Staged(arrow_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n long, c1 long, c2 long, key long, data binary"), "digests")


def postings(docs: DataFrame, sketch: np.ndarray, n: int, percent: int, blocks: int) -> DataFrame:
    """Blocks of columns: rows (block, hashes, ids, marks) of packed arrays; a mark says that the column is in the row's shorter, index prefix. Copies within a task are left out but for the first."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def make():
        counts = held.value
        seen: set[bytes] = set()
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        gathered = 0

        def hand_on():
            nonlocal kept, gathered
            if not kept:
                return None
            h, d, f = (np.concatenate(x) for x in zip(*kept))
            kept, gathered = [], 0
            block = (h % np.uint64(blocks)).astype(np.int64)
            hot = counts[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // HOT_COLUMN
            salt = np.where(hot > 0, 1 + d % (hot + 1), 0)
            key = block + blocks * salt
            order = np.argsort(key, kind="stable")
            key, h, d, f = key[order], h[order], d[order], f[order]
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() + [len(key)]
            return {"block": [int(key[a]) for a in cuts[:-1]], "hashes": [h[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], "ids": [d[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], "marks": [f[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}

        def step(batch):
            nonlocal gathered
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_hashes(text, n)
                if not len(s) or doc is None:
                    continue
                d = xxhash.xxh3_128_digest(s.tobytes())
                if d in seen:
                    continue
                seen.add(d)
                c = np.minimum(counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
                order = (c << np.uint64(40)) | (s & np.uint64((1 << 40) - 1))
                p = int(prefix_size(len(s), percent))
                q = int(index_size(len(s), percent))
                ranks = np.partition(order, sorted({p - 1, q - 1}))
                taken = order <= ranks[p - 1]  # equal places are all taken
                s, front = s[taken], order[taken] <= ranks[q - 1]
                kept.append((s, np.full(len(s), doc, dtype=np.int64), front))
                gathered += len(s)
            return hand_on() if gathered >= GATHERED else None

        step.finish = hand_on
        return step

    return arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "block long, hashes binary, ids binary, marks binary")


def shared_columns(blocks: DataFrame, count: int) -> DataFrame:
    """(h, d, f) of the columns with two rows or more. Blocks that hold part of a common column keep all of it."""

    def make():
        own: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def step(batch):
            for b, *x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                own.setdefault(b, []).append(tuple(np.frombuffer(y.as_buffer(), dtype=t).copy() for y, t in zip(x, (np.uint64, np.int64, np.bool_))))

        def finish():
            out = []
            for b, parts in own.items():
                h, d, f = (np.concatenate(x) for x in zip(*parts))
                if b < count:
                    order = np.argsort(h, kind="stable")
                    h, d, f = h[order], d[order], f[order]
                    same = h[1:] == h[:-1]
                    keep = np.r_[False, same] | np.r_[same, False]
                    h, d, f = h[keep], d[keep], f[keep]
                out.append((h, d, f))
            own.clear()
            if not out:
                return None
            h, d, f = (np.concatenate(x) for x in zip(*out))
            return {"h": h.view(np.int64), "d": d, "f": f}

        step.finish = finish
        return step

    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, count)
    return arrow_rows(blocks.repartition(tasks, "block"), make, "h long, d long, f boolean", batch_rows=32)


def components(edges: DataFrame) -> tuple[DataFrame, Staged]:
    """(node, root): for each node of the edges (a, b) the smallest node it is connected with, and the table that this reads. Alternating large and small stars.

    Each round is written to the shared folder. Every node joins its smallest neighbour, so hubs of very many edges take part as
    sums (partial minima), never as one gathered list.
    """
    state = Staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    while True:
        e = state.df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        new = Staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state.drop()
        state = new
        mark = state.df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == last:
            break
        last = mark
    roots = state.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.df.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), state


def compared(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> Staged:
    """(a, b, linked, distance) of the pairs (a, b), from whole sets. Texts are read again for the documents of the pairs only."""
    pairs = Staged(pairs.select("a", "b"), "compare")
    few = count_of(pairs.df) <= SMALL  # of two numbers each: else both joins shuffle
    hint = F.broadcast if few else lambda df: df
    first, second = pairs.df.select(F.col("a").alias("doc_id")).distinct(), pairs.df.select(F.col("b").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(hint(first.union(second).distinct()), "doc_id", "left_semi")

    def sets():
        return lambda batch: {"doc_id": batch.column(0), "s": [shingle_hashes(t, n).tobytes() for t in batch.column(1).to_pylist()]}

    known = Staged(arrow_rows(texts, sets, "doc_id long, s binary"), "sets")
    left = known.df.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")).join(hint(pairs.df), "b")
    right = known.df.join(hint(first), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    both = left.join(right, "a").select("a", "b", "sa", "sb")

    def decide():
        def step(batch):
            link, distance = [], []
            for sx, sy in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(sx.as_buffer(), dtype=np.uint64), np.frombuffer(sy.as_buffer(), dtype=np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                i = int((both[1:] == both[:-1]).sum())
                link.append(i >= needed(len(p), len(q), percent))
                distance.append(1 - i / (len(p) + len(q) - i))
            return {"a": batch.column(0), "b": batch.column(1), "linked": link, "distance": distance}

        return step

    out = Staged(arrow_rows(both, decide, "a long, b long, linked boolean, distance double", batch_rows=100), "compared", rows=100)
    known.drop()
    pairs.drop()
    return out


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    steps: list[Staged] = []

    def keep(table: Staged) -> Staged:
        steps.append(table)
        return table

    read = keep(digests(docs, n))
    rows = read.df.where("key IS NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "c1", "c2")
    parts = total_of(read.df.where("key IS NOT NULL").select("key", "data"), "<i4")
    width = 1 << 15
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    for k, x in parts.items():
        sketch[k * width : (k + 1) * width] = x
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # classes of copies alone, from a table, so that Spark can split the join's hot classes
    classes = keep(Staged(classes.where("copies > 1").drop("copies"), "copies")).df
    named = Staged(rows.join(classes, ["c1", "c2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "classes").df
    whole = rows.agg(F.sum("n")).first()[0] or 0
    count = max(8, int(whole * (100 - percent) / 100 / BLOCK_POSTINGS) + 1)
    member = named.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("d"), "n", F.col("rep").alias("r")).distinct()
    columns = shared_columns(postings(docs, sketch, n, percent, count), count)
    table = keep(Staged(columns.join(member, "d").groupBy("h", "r", "n").agg(F.max("f").alias("f")), "columns", rows=32)).df  # rows of blocks are large
    # first run: each row with the hubs of its columns
    hubs = table.groupBy("h").agg(F.min(F.struct("r", "n")).alias("hub"), F.count("*").alias("rows")).where("rows > 1")
    starred = table.join(hubs, "h").select(F.col("hub.r").alias("a"), F.col("hub.n").alias("na"), F.col("r").alias("b"), F.col("n").alias("nb")).where("a <> b")
    counted = enough(starred, percent)
    best = counted.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).where("k <= 2").select("a", "b")
    first = keep(compared(docs, best, n, percent)).df.where("linked")
    roots, edges = components(first)
    roots = keep(Staged(roots, "roots")).df
    edges.drop()
    groups = first.groupBy(F.col("b").alias("r")).agg(F.min(F.struct("distance", F.col("a").alias("hub"))).alias("g"))
    rows = table.select("r", "n").distinct().join(groups, "r", "left").join(roots.select(F.col("node").alias("r"), "root"), "r", "left")
    rows = keep(Staged(rows.select("r", "n", F.coalesce("g.hub", "r").alias("g"), F.coalesce("g.distance", F.lit(0.0)).alias("d"), F.coalesce("root", "r").alias("root")), "groups")).df
    # second run: groups of different components that meet in a column
    own = rows.groupBy("g", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("d").alias("reach"), F.count("*").alias("size"))
    met = table.join(rows.select("r", "g", "root"), "r").groupBy("h", "g", "root").agg(F.max("f").alias("f"), F.min("n").alias("low"), F.max("n").alias("high"))
    mixed = met.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    met = met.join(mixed, "h", "left_semi")
    x, y = (met.select("h", F.col("g").alias(f"g{i}"), F.col("root").alias(f"r{i}"), F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}"), F.col("f").alias(f"f{i}")) for i in "xy")
    fits = (F.col("lowx") * percent <= F.col("highy") * 100) & (F.col("lowy") * percent <= F.col("highx") * 100)
    met_in = x.join(y, "h").where((F.col("gx") < F.col("gy")) & (F.col("rx") != F.col("ry")) & fits)
    # counts accumulate over columns; of linked sets one has the column of one of its index places
    pairs = met_in.groupBy(F.col("gx").alias("a"), F.col("gy").alias("b")).agg(F.count("*").alias("c"), F.max(F.col("fx") | F.col("fy")).alias("f")).where("f")
    side = lambda i: own.select(F.col("g").alias(i), F.col("root").alias(f"r{i}"), F.col("reach").alias(f"reach{i}"), F.col("size").alias(f"size{i}"), F.col("low").alias(f"n{i}"))
    # where both groups are one row, c is what their prefixes share
    enough_shared = F.col("c") >= least_shared(F.col("na"), F.col("nb"), percent)
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("ra") != F.col("rb")).where((F.col("sizea") > 1) | (F.col("sizeb") > 1) | enough_shared)
    pairs = keep(Staged(pairs.select("a", "b", "reacha", "reachb", "sizea", "sizeb"), "pairs")).df
    second = keep(compared(docs, pairs.select("a", "b"), n, percent)).df
    # hubs too far for a link: members that could be near enough
    limit = 1 - percent / 100 + 1e-9
    far = pairs.join(second.where("NOT linked"), ["a", "b"]).where(F.col("distance") <= F.col("reacha") + F.col("reachb") + limit)
    # a is the smaller group: its members come first, and the larger one's are compared with them as they are joined
    turned = F.col("sizea") > F.col("sizeb")
    swap = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    far = keep(Staged(far.select(swap("a", "b", "a"), swap("b", "a", "b"), swap("reacha", "reachb", "reacha"), swap("reachb", "reacha", "reachb"), "distance"), "far")).df
    near = rows.join(far.select(F.col("a").alias("g")).union(far.select("b")).distinct(), "g", "left_semi")
    near = near.join(table.join(near.select("r"), "r", "left_semi").groupBy("r").agg(F.collect_set("h").alias("hs")), "r")  # no more than each row's own prefix
    near = keep(Staged(near.select("g", "r", "n", "d", "hs"), "near")).df
    ends = lambda i: near.select(F.col("g").alias(i), *(F.col(c).alias(f"{k}{i}") for c, k in (("r", "m"), ("n", "n"), ("d", "d"), ("hs", "h"))))
    sized = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    shared = F.size(F.array_intersect("ha", "hb")) >= least_shared(F.col("na"), F.col("nb"), percent)
    far = far.join(ends("a"), "a").where(F.col("da") >= F.col("distance") - F.col("reachb") - limit)
    far = far.join(ends("b"), "b").where((F.col("da") + F.col("db") >= F.col("distance") - limit) & sized & shared)
    far = far.where((F.col("ma") != F.col("a")) | (F.col("mb") != F.col("b"))).select(F.col("ma").alias("a"), F.col("mb").alias("b")).distinct()
    third = keep(compared(docs, far, n, percent)).df
    final, _ = components(first.union(second.where("linked")).union(third.where("linked")))
    for table in steps:  # all but the tables `named` and `final`, which the result reads
        table.drop()
    return named.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def least_shared(na, nb, percent: int):
    """How many columns the prefixes of linked sets of these sizes share at least."""
    least = F.ceil((percent * (na + nb)) / F.lit(100 + percent) - 1e-9)
    prefix = lambda x: x - F.ceil(percent * x / F.lit(100) - 1e-9) + 1
    return F.least(prefix(na) - na + least, prefix(nb) - nb + least)


def enough(pairs: DataFrame, percent: int) -> DataFrame:
    """Accumulates overlap counts (c) of pairs (a, na, b, nb) over columns, and discards pairs below the bound from their sizes.

    Of linked sets all but n - needed elements of a prefix are shared, and what the shorter reaching prefix shares lies in both.
    """
    na, nb = F.col("na"), F.col("nb")
    sized = pairs.where((na * 100 >= nb * percent) & (nb * 100 >= na * percent))
    return sized.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= least_shared(na, nb, percent))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without those rows that a document of smaller id in their component stands for. Rows with a null id stay, and those of a repeated id if one of them stands for itself."""
    found = near_duplicates(docs, n=n, percent=percent)
    copies = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("NOT first")
    return without_ids(docs, copies, "copies")
