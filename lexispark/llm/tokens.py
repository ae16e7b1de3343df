"""Token ids of whole texts, and token counts kept under edits.

Ids are those of the byte-level BPE that `tokenizers` reads from byte_bpe_50k.json. The
same vocabulary as ranks is read by `tiktoken`, which is several times faster; texts that
hold the string of a special token, or that the faster library refuses, go to `tokenizers`.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np


class Encoder:
    """Ids, as little-endian unsigned 32-bit bytes, by text."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if path is None:
            import tiktoken

            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
            except ValueError:  # its pattern gave up on the text
                pass
        return self.slow(text)

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def count(self, text: str) -> int:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return len(self.fast.encode_ordinary(text))
            except ValueError:
                pass
        return len(self.slow(text)) // 4


#: A place before a space that has no white space on either side: pre-tokens end there whatever stands around, so parts can be encoded apart.
SAFE = re.compile(r"(?<=\S) (?=\S)")


#: Most children of an inner node; half as many when a full one is split.
FAN = 16


class Node:
    """A leaf (text) or an inner node (children), with the sums of what is below it."""

    __slots__ = ("below", "chars", "leaves", "tokens")

    def __init__(self, below: str | list[Node], tokens: int = 0):
        self.below = below
        if isinstance(below, str):
            self.chars, self.tokens, self.leaves = len(below), tokens, 1
        else:
            self.chars, self.tokens, self.leaves = sum(x.chars for x in below), sum(x.tokens for x in below), sum(x.leaves for x in below)


def stacked(nodes: list[Node]) -> list[Node]:
    """Nodes of one level under as few nodes of the next as hold them."""
    parts = -(-len(nodes) // FAN)
    return [Node(nodes[k * len(nodes) // parts : (k + 1) * len(nodes) // parts]) for k in range(parts)]


class SegmentTree:
    """Token counts of a document by pre-token segments, kept under edits.

    Leaves are runs of characters that end at safe cuts (`is_safe`), about `leaf_chars` long; inner nodes hold
    the sums of characters and tokens of the nodes below them, so a place is found and sums are updated along one
    path. An edit re-encodes the leaves it touches and their neighbours, up to safe cuts, and makes the nodes above these anew;
    all other nodes stay as they are, also where the number of leaves changes.
    """

    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = 512):
        self.count, self.leaf_chars = count, leaf_chars
        self.encoded = 0  # characters given to the tokeniser so far
        self._top([self._leaf(x) for x in self._cut(text)])

    @classmethod
    def restored(cls, shape: list[int], leaves: list[str], tokens: list[int], count: Callable[[str], int], leaf_chars: int = 512) -> SegmentTree:
        """A tree from what `stored` gave; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.leaf_chars, tree.encoded = count, leaf_chars, 0
        own, sizes = zip(leaves, tokens), iter(shape)

        def node() -> Node:
            children = next(sizes)
            return Node([node() for _ in range(children)]) if children else Node(*next(own))

        tree.root = node()
        return tree

    def stored(self) -> tuple[list[int], list[str], list[int]]:
        """Number of children of each node from the top down, 0 for leaves; texts and tokens of the leaves."""
        shape, leaves, tokens, stack = [], [], [], [self.root]
        while stack:
            x = stack.pop()
            if isinstance(x.below, str):
                shape.append(0)
                leaves.append(x.below)
                tokens.append(x.tokens)
            else:
                shape.append(len(x.below))
                stack += reversed(x.below)
        return shape, leaves, tokens

    def _top(self, nodes: list[Node]) -> None:
        while len(nodes) > 1:
            nodes = stacked(nodes)
        self.root = nodes[0] if nodes else self._leaf("")
        while not isinstance(self.root.below, str) and len(self.root.below) == 1:
            self.root = self.root.below[0]

    def _cut(self, text: str) -> list[str]:
        """Cuts a text into leaves; the first and the last character's side are the caller's business."""
        out, at, n = [], 0, len(text)
        while n - at > self.leaf_chars:
            cut = safe_cut(text, at + self.leaf_chars)
            if cut is None:
                break
            out.append(text[at:cut])
            at = cut
        if at < n or not out:
            out.append(text[at:])
        return out

    def _leaf(self, text: str) -> Node:
        self.encoded += len(text)
        return Node(text, self.count(text) if text else 0)

    @property
    def chars(self) -> int:
        return self.root.chars

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def text(self) -> str:
        return "".join(self.stored()[1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, and the place within it; the end of the text is in the last leaf."""
        x, i = self.root, 0
        while not isinstance(x.below, str):
            for child in x.below:
                if place < child.chars or child is x.below[-1]:
                    x = child
                    break
                place -= child.chars
                i += child.leaves
        return i, place

    def leaf(self, i: int) -> str:
        x = self.root
        while not isinstance(x.below, str):
            for child in x.below:
                if i < child.leaves:
                    x = child
                    break
                i -= child.leaves
        return x.below

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in the place of the characters from start to end."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError(f"edit {start}:{end} is outside 0:{self.chars}")
        (a, x), (b, y), count = self.find(start), self.find(end), self.root.leaves
        first, last = max(0, a - 1), min(count - 1, b + 1)
        before = self.leaf(first) if first < a else ""
        region = before + self.leaf(a)[:x] + new + self.leaf(b)[y:] + (self.leaf(last) if last > b else "")
        # the cuts at both ends of the region must be safe as they are now; widen it until they are
        while first > 0 and not is_safe(self.leaf(first - 1), region):
            first -= 1
            region = self.leaf(first) + region
        while last + 1 < count and not is_safe(region, self.leaf(last + 1)):
            last += 1
            region += self.leaf(last)
        fresh = [self._leaf(t) for t in self._cut(region)] if region else []
        self._top(self._replaced(self.root, first, last + 1, fresh))

    def _replaced(self, node: Node, first: int, last: int, fresh: list[Node]) -> list[Node]:
        """Nodes of this node's level, with the leaves from first to last (exclusive) replaced. Only nodes on the two paths are made anew."""
        if isinstance(node.below, str):
            return fresh
        children: list[Node] = []
        at, put = 0, False
        for child in node.below:
            low, high = first - at, last - at
            at += child.leaves
            if high <= 0 or low >= child.leaves:
                children.append(child)
            elif put:  # what is new stands in an earlier child
                if high < child.leaves:
                    children += self._replaced(child, 0, high, [])
            else:
                put = True
                children += self._replaced(child, max(0, low), min(high, child.leaves), fresh)
        if not children:
            return []
        joined = [children[0]]
        for child in children[1:]:  # small neighbours become one node
            left = joined[-1]
            if not isinstance(left.below, str) and len(left.below) + len(child.below) <= FAN // 2:
                joined[-1] = Node(left.below + child.below)
            else:
                joined.append(child)
        return stacked(joined)


def is_safe(left: str, right: str) -> bool:
    """Whether left and right, in a row, can be encoded apart."""
    return bool(left) and len(right) > 1 and right[0] == " " and not left[-1].isspace() and not right[1].isspace()


def safe_cut(text: str, at: int) -> int | None:
    """The first safe cut at or after a place."""
    m = SAFE.search(text, at)
    return m.start() if m else None
