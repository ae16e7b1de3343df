"""Minimax contiguous sharding of atomic groups, by bytes.

Groups (equal texts) are ordered by a 64-bit hash of the text. The smallest capacity for which
greedy filling needs no more than the shards there are is found by binary search, and the order is cut where
greedy filling with it cuts. Groups larger than an even share get shards of their own
first. The driver never sees the groups: it holds sums by ranges of the hash (65,536 to begin
with), and where a cut of a still possible capacity falls inside a range, that range alone
is split by the next 16 bits of the hash.

Nulls: a null text counts as empty. Texts whose hashes are equal stay together. Repeated rows
belong to one group. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, gapless

BITS, LEVELS = 16, 4


class Ranges:
    """Sums of bytes by ranges of the hash in order; level 4 is a single hash value."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.level, self.prefix, self.bytes, self.count = self._fetch(0, None)

    def _fetch(self, level: int, parents: list[int] | None):
        shift = 64 - BITS * (level + 1)
        g = self.groups.withColumn("p", F.shiftright("key", shift)) if shift else self.groups.withColumn("p", F.col("key"))
        if parents is not None:
            g = g.where(F.shiftright("key", shift + BITS).isin(parents))
        rows = g.groupBy("p").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy("p").collect()  # at most 2**16 a parent
        return (np.full(len(rows), level), np.array([r["p"] for r in rows], dtype=np.int64), np.array([r["bytes"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64))

    def split(self, at: np.ndarray) -> None:
        """Replaces the ranges at these places by their parts."""
        for level in sorted(set(self.level[at].tolist())):
            own = at[self.level[at] == level]
            new = self._fetch(level + 1, self.prefix[own].tolist())
            keep = np.ones(len(self.level), dtype=bool)
            keep[own] = False
            cat = [np.concatenate([x[keep], y]) for x, y in zip((self.level, self.prefix, self.bytes, self.count), new)]
            first = np.array([int(p) << (64 - BITS * (int(lv) + 1)) for lv, p in zip(cat[0], cat[1])], dtype=np.int64)
            order = np.argsort(first, kind="stable")
            self.level, self.prefix, self.bytes, self.count = (x[order] for x in cat)
            at = np.empty(0, dtype=np.int64) if level == max(self.level[at].tolist(), default=level) else at
            if len(at):  # places moved: the caller asks again
                return

    @property
    def atomic(self) -> np.ndarray:
        return (self.count == 1) | (self.level == LEVELS - 1)

    def last_key(self, i: int) -> int:
        """The greatest hash of the range at place i."""
        shift = 64 - BITS * (int(self.level[i]) + 1)
        return (int(self.prefix[i]) << shift) + (1 << shift) - 1


def greedy(total: np.ndarray, atomic: np.ndarray, capacity: int, shards: int) -> tuple[bool | None, list[int], np.ndarray]:
    """Fills shards in order. total: running sums from 0. Returns whether `shards` suffice (None: not known yet), the cuts (places), and the ranges to split to know.

    Ranges that aren't atomic can be cut anywhere at best and nowhere at worst; a range between both bounds is uncertain.
    """
    worst, best, cuts, unsure = 0, 0.0, [], []
    n = len(atomic)
    for _ in range(shards):
        best = min(float(total[-1]), best + capacity)
        i = int(np.searchsorted(total, total[worst] + capacity, side="right")) - 1  # ranges before i fit
        if i < n and not atomic[i]:
            unsure.append(i)
        j = min(n - 1, int(np.searchsorted(total, best, side="right")) - 1)
        if atomic[j] and best < total[j + 1]:
            best = float(total[j])
        elif j != i and not atomic[j]:
            unsure.append(j)
        worst = i
        cuts.append(i)
        if worst >= n:
            return True, cuts, np.array([], dtype=np.int64)
    if best < total[-1]:
        return False, cuts, np.array([], dtype=np.int64)
    return (None, cuts, np.unique(np.array(unsure, dtype=np.int64))) if unsure else (False, cuts, np.array([], dtype=np.int64))


def minimax_cuts(groups: DataFrame, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the greatest hash of each shard but the last."""
    ranges = Ranges(groups)
    if not len(ranges.bytes) or shards <= 1:
        return int(ranges.bytes.sum()), []
    whole = int(ranges.bytes.sum())
    low, high = max(largest, -(-whole // shards)), -(-whole // shards) + largest
    while low < high:
        middle = (low + high) // 2
        total = np.concatenate([[0], np.cumsum(ranges.bytes)])
        ok, _, unsure = greedy(total, ranges.atomic, middle, shards)
        if ok is None:
            ranges.split(unsure)
        elif ok:
            high = middle
        else:
            low = middle + 1
    while True:  # the cuts themselves must be exact
        total = np.concatenate([[0], np.cumsum(ranges.bytes)])
        place, cuts, split = 0, [], None
        for _ in range(shards):
            place = int(np.searchsorted(total, total[place] + low, side="right")) - 1
            if place >= len(ranges.bytes):
                break
            if not ranges.atomic[place]:
                split = place
                break
            cuts.append(place)
        if split is None:
            return low, [ranges.last_key(c - 1) for c in cuts]
        ranges.split(np.array([split]))


def shard_documents(docs: DataFrame, *, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs. The law is `bytes`."""
    text = F.coalesce("text", F.lit(""))
    rows = Staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("turn")), "shard-rows").df  # turn tells repeated rows apart
    groups_table = Staged(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    groups = groups_table.df
    sums = groups.agg(F.sum("bytes"), F.sum("n")).first()
    whole, count = sums[0] or 0, sums[1] or 0
    giants, left = [], shards
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if left > 1 and r["bytes"] * left > whole:
            giants.append(r["key"])
            whole -= r["bytes"]
            left -= 1
        else:
            break
    rest = groups.where(~F.col("key").isin(giants)) if giants else groups
    largest = rest.agg(F.max("bytes")).first()[0] or 0
    _, cuts = minimax_cuts(rest.select("key", "bytes"), left, largest)
    groups_table.drop()
    own = lambda k: F.lit(shards - 1 - giants.index(k))
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") > F.lit(c)).cast("int")
    for k in giants:
        shard = F.when(F.col("key") == k, own(k)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int"))
    out = gapless(placed, "shard", ["doc_id", "key", "turn"], int(count), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
