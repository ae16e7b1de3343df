"""Edit-aware token counts: each document keeps a segment tree over its pre-token segments.

`build_trees` makes a table of trees, which is written and kept; `with_edits` joins a table of edits to it, and
`edit_trees` applies them and returns the trees to keep, with their counts. Only the leaves that an edit touches, with their
neighbours up to places where parts can be encoded apart, are encoded again; sums change along the paths above. No text is
encoded twice: a kept tree is read back with its counts. `count_tokens` counts whole texts at once.
Counts equal those of encoding the edited text anew.

Nulls: a null text counts as empty, a null list of edits as none, a null new text as a deletion.
Places outside the text are moved to its ends. Empty texts have 0 tokens. Repeated rows count alike; edits of an id go to all rows
of that id, none to rows without one. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, arrow_rows
from .tokens import Encoder, SegmentTree

EDITS = "array<struct<start:bigint,end:bigint,new:string>>"


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens of whole texts."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        encoder = Encoder(tokenizer)
        return lambda batch: {"doc_id": batch.column(0), "n_tokens": [encoder.count(t or "") for t in batch.column(1).to_pylist()]}

    return arrow_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long")


TREE = "shape array<int>, leaves array<string>, tokens array<long>"


def build_trees(docs: DataFrame, *, leaf_chars: int = 512, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, and the tree of each row of docs (doc_id, text): shape, leaves, tokens as `SegmentTree.stored` gives them."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        encoder = Encoder(tokenizer)

        def step(batch):
            out = {k: [] for k in ("n_chars", "n_tokens", "shape", "leaves", "tokens")}
            for text in batch.column(1).to_pylist():
                tree = SegmentTree(text or "", encoder.count, leaf_chars)
                for k, x in zip(out, (tree.chars, tree.tokens, *tree.stored())):
                    out[k].append(x)
            return out | {"doc_id": batch.column(0)}

        return step

    return arrow_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_chars long, n_tokens long, {TREE}")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the column `edits` from rows (doc_id, step, start, end, new), in the order of step; equal steps by their other columns. An id's edits are one row: they depend on each other."""
    each = edits.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step", "start", "end", "new"))).alias("_edits"))
    own = F.transform("_edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].alias("new")))
    return trees.join(each, "doc_id", "left").select(*(c for c in trees.columns if c != "edits"), own.alias("edits"))


def edit_trees(trees: DataFrame, *, leaf_chars: int = 512, tokenizer: str | None = None, keep: bool = True) -> DataFrame:
    """Applies each tree's `edits` (start, end, new; places in the text as the edits before left it).

    Returns doc_id, n_tokens (before), n_tokens_edited, n_chars_edited, n_chars_encoded (by the edits), and the trees as they
    are now, if they are to be kept.
    """
    kind = dict(trees.dtypes)["doc_id"]
    names = ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]

    def make():
        encoder = Encoder(tokenizer)

        def step(batch):
            out = {k: [] for k in names + ["shape", "leaves", "tokens"] * keep}
            for shape, leaves, tokens, edits in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                tree = SegmentTree.restored(shape, leaves, tokens, encoder.count, leaf_chars)
                before = tree.tokens
                for e in edits or []:
                    start = min(max(0, e["start"] or 0), tree.chars)
                    tree.edit(start, min(max(start, e["end"] or 0), tree.chars), e["new"] or "")
                for k, x in zip(out, (before, tree.tokens, tree.chars, tree.encoded, *(tree.stored() if keep else ()))):
                    out[k].append(x)
            return out | {"doc_id": batch.column(0)}

        return step

    given = trees.select("doc_id", "shape", "leaves", "tokens", F.col("edits").cast(EDITS))
    return arrow_rows(given, make, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + (f", {TREE}" if keep else ""))


def count_after_sample_edits(docs: DataFrame, *, leaf_chars: int = 512, tokenizer: str | None = None) -> DataFrame:
    """Builds the trees of docs (doc_id, text), keeps them in the shared folder, and counts before and after `sample_edits` of every kept tree."""
    trees = Staged(build_trees(docs, leaf_chars=leaf_chars, tokenizer=tokenizer), "trees").df
    return edit_trees(trees.withColumn("edits", sample_edits()), leaf_chars=leaf_chars, tokenizer=tokenizer, keep=False)


def sample_edits(n_chars="n_chars"):
    """Three edits of any text, by its length: a heading put before it, seven characters in its middle replaced, its last five deleted."""
    n = F.coalesce(F.col(n_chars), F.lit(0)).cast("long")
    head = "Second edition. "
    half = F.floor((n + len(head)) / 2)
    end = n + F.lit(len(head))
    after = half + 7 + F.greatest(F.lit(0), end - half - 7)  # the length after the replacement
    edit = lambda s, e, new: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), F.lit(new).alias("new"))
    return F.array(edit(F.lit(0), F.lit(0), head), edit(half, F.least(end, half + 7), "changed"), edit(F.greatest(F.lit(0), after - 5), after, ""))
