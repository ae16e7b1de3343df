"""Best-fit packing of token sequences by a plan over the histogram of lengths.

Only the histogram (one count for each length up to the capacity) reaches the driver, whatever
the number of documents. Best fit decreasing runs over counts: all pieces of one length are placed
together into the fullest kinds of sequences that take them. The plan is a table of slots
(length, first rank, number of ranks, first sequence, offset); a document takes the
slot of its rank among the pieces of its length. Ranks come from counts by (length, salt) and
a row number within each of these, so a length that a third of all rows have isn't one task's work.

Nulls: a null text counts as empty; an empty document has the end mark alone. Rows with equal ids and
texts are documents of their own. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, arrow_rows, gapless
from .tokens import Encoder

#: The id that ends each document, and the length of a sequence.
END_ID, CAPACITY = 2, 1024

def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, turn of each piece of each document. Only documents longer than the capacity are cut; the first piece takes what is over.

    turn numbers the pieces of a task, which tells repeated rows apart.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        encoder, end, turn = Encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 0

        def step(batch):
            nonlocal turn
            rows: list[list[int]] = [[], [], [], [], []]
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                starts = [0, *range(first, n, capacity)]
                for p, s in enumerate(starts):
                    e = min(n, s + (capacity if p else first))
                    for column, x in zip(rows, (k, p, s, e - s, zlib.crc32(ids[4 * s : 4 * e]))):
                        column.append(x)
            turn += len(rows[0])
            turns = range(turn - len(rows[0]), turn)
            return {"doc_id": batch.column(0).take(np_to_arrow(rows[0])), "piece": rows[1], "start": rows[2], "length": rows[3], "ids_crc32": rows[4], "turn": turns}

        return step

    return arrow_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, turn long")


def np_to_arrow(rows: list[int]):
    import pyarrow as pa

    return pa.array(rows, type=pa.int64())


@dataclass
class Kind:
    """Sequences that are filled alike: the first one's number, how many, room left, offset of the next piece."""

    first: int
    count: int
    room: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, ranks, first sequence, offset), and the number of sequences. Best fit decreasing over counts.

    The number of slots depends on the capacity, not on the counts: each length opens or splits a few kinds.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    by_room: dict[int, list[Kind]] = {}
    total = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")

        def fill(first: int, count: int, room: int) -> int:
            """Puts pieces of this length into sequences with this room, as many into each as fit; how many sequences took any."""
            nonlocal left, rank
            used = 0
            while left and used < count:
                each = min(room // length, left)
                n = min(count - used, left // each)
                for k in range(each):
                    slots.append((length, rank, n, first + used, capacity - room + k * length))
                    rank += n
                left -= n * each
                by_room.setdefault(room - each * length, []).append(Kind(first + used, n, room - each * length))
                used += n
            return used

        room = length
        while left and room < capacity:  # the fullest sequences first; those filled here have less room than a piece, or took the last one
            kinds = by_room.pop(room, [])
            while left and kinds:
                kind = kinds.pop()
                used = fill(kind.first, kind.count, room)
                if used < kind.count:
                    kinds.append(Kind(kind.first + used, kind.count - used, room))
            by_room.setdefault(room, []).extend(kinds)
            room += 1
        if left:
            total += fill(total, left, capacity)
    return slots, total


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length, ...) with sequence_id and offset: gapless within each sequence, lengths in all at most the capacity.

    Other columns stay. parts must not have columns named sequence_id or offset, nor any whose name begins with `_`: these are made here.
    Rows equal in doc_id, piece, ids_crc32 and turn (the last two where there are such columns) are ranked by one task a salt.
    """
    clash = [c for c in parts.columns if c in ("sequence_id", "offset") or c.startswith("_")]
    if clash:
        raise ValueError(f"columns {clash} are made by pack; rename them first")
    spark = parts.sparkSession
    counts = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    histogram = {r["length"]: r["n"] for r in counts}
    slots, _ = plan(histogram, capacity)
    ranked = gapless(parts, "length", ["doc_id", "piece", *(c for c in ("ids_crc32", "turn") if c in parts.columns)], sum(histogram.values()), "_rank")
    # the slots of a length, as arrays: a row for each length, capacity rows at most, so the table's size is bounded by the plan
    table = spark.createDataFrame(slots, "length long, first_rank long, ranks long, first_sequence long, offset long")
    table = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first_rank", "ranks", "first_sequence", "offset"))).alias("_slots"))
    slot = F.element_at(F.filter("_slots", lambda s: (s["first_rank"] <= F.col("_rank")) & (F.col("_rank") < s["first_rank"] + s["ranks"])), 1)
    placed = ranked.join(F.broadcast(table), "length").withColumn("_slot", slot)
    placed = placed.withColumn("sequence_id", F.col("_slot.first_sequence") + F.col("_rank") - F.col("_slot.first_rank")).withColumn("offset", F.col("_slot.offset"))
    return placed.select(*parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents' pieces. Texts are encoded once; the pieces wait in the shared folder."""
    staged = Staged(pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer), "pieces")
    return pack(staged.df, capacity=capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
