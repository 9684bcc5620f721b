"""Token counts that follow edits without encoding a text again.

A text is cut into units, a run of white space with the word after it, at places where
the vocabulary's pre-tokenizer always cuts. LEAF units in a row are a leaf; a segment
tree over the leaves holds sums of code points and of tokens. An edit finds its leaves
by descending on code points, takes one more leaf where it touches a leaf's first or
last unit (white space and words join there), cuts and encodes that stretch alone, and
updates the sums on the paths above. The total is the root's sum.

A leaf holds up to 2 * LEAF units, and nodes have up to FANOUT children. One that grows beyond that is split in
place, an empty one is taken out, so an edit touches as many nodes as the tree is high,
and those that a deletion removes; nothing is rebuilt.

Edits are (at, remove, insert): from code point `at` of the text as edited so far, `remove`
code points go and `insert` comes. Places outside the text are moved to its end, negative
numbers count as 0; a null edit, or one without place and text, changes nothing.

Nulls: a null text has no tokens and takes edits as an empty one does; a null doc_id stays.
Texts are read whole, at any length. Repeated rows each give a result. An empty table
gives an empty result. Other columns are not read.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT, UnitEncoder, encode_with, encoder, plain, slices, unit_sizes
from .shared import lean, small_batches
from .words import utf8

LEAF = 64  # units of a new leaf
FANOUT = 16
#: The white space of the pre-tokenizer (Unicode property White_Space)
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = regex.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
RESULT = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_leaves long, n_chars_encoded long"


def cut_units(text: str) -> list[int]:
    """Places, in code points, where units start, and the text's end."""
    return [0, *(m.start() for m in _CUT.finditer(text)), len(text)] if text else [0]


class _Node:
    """A leaf with its text, or an inner node with its children; sums of code points and of tokens."""

    __slots__ = ("chars", "children", "parent", "text", "tokens", "units")

    def __init__(self, text: str = "", tokens: int = 0, units: int = 0, children: list[_Node] | None = None):
        self.text, self.tokens, self.units, self.chars = text, tokens, units, len(text)
        self.children, self.parent = children, None


class TokenTree:
    """Leaves of a text with sums of code points and tokens. `encoded` counts the code points that edits encoded,
    `summed` the nodes whose sums they updated."""

    def __init__(self, text: str, encode, units: list[int] | np.ndarray | None = None, tokens: np.ndarray | None = None):
        self.encode, self.encoded, self.summed = encode, 0, 0
        at = list(units) if units is not None else cut_units(text)
        counts = None
        if tokens is not None:
            counts = np.add.reduceat(tokens, np.arange(0, len(tokens), LEAF)).tolist() if len(tokens) else []
        level = self._leaves(text, at, counts)
        while len(level) > 1 or not level or level[0].children is None:
            level = [self._inner(level[k : k + FANOUT // 2]) for k in range(0, max(1, len(level)), FANOUT // 2)]
        self.root, self.summed = level[0], 0

    def _leaves(self, text: str, at: list[int], counts: list[int] | None = None) -> list[_Node]:
        """LEAF units each, so that a leaf has room to grow; `at` are the starts of units and the text's end."""
        edges = [*at[:-1:LEAF], at[-1]] if len(at) > 1 else [0]
        parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        counts = [len(self.encode(p)) for p in parts] if counts is None else counts
        return [_Node(p, n, min(LEAF, len(at) - 1 - LEAF * k)) for k, (p, n) in enumerate(zip(parts, counts, strict=True))]

    def _inner(self, children: list[_Node]) -> _Node:
        node = _Node(children=children)
        for c in children:
            c.parent = node
        self._sum(node)
        return node

    def _sum(self, node: _Node) -> None:
        node.tokens, node.chars = sum(c.tokens for c in node.children), sum(c.chars for c in node.children)
        self.summed += 1

    @property
    def total(self) -> int:
        return self.root.tokens

    def leaves(self) -> list[_Node]:
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            if n.children is None:
                out.append(n)
            else:
                todo += reversed(n.children)
        return out

    @property
    def text(self) -> str:
        return "".join(n.text for n in self.leaves())

    def find(self, at: int) -> tuple[_Node | None, int]:
        """The leaf of a code point, and the place in it; the last leaf for the text's end. None in an empty tree."""
        n = self.root
        while n is not None and n.children is not None:
            inside = None
            for c in n.children:
                inside = c
                if at < c.chars or c is n.children[-1]:
                    break
                at -= c.chars
            n = inside
        return n, at

    @staticmethod
    def _beside(leaf: _Node, step: int) -> _Node | None:
        """The leaf before (-1) or after (1) a leaf."""
        n = leaf
        while n.parent is not None:
            k = n.parent.children.index(n) + step
            if 0 <= k < len(n.parent.children):
                n = n.parent.children[k]
                while n.children is not None:
                    n = n.children[-1 if step < 0 else 0]
                return n
            n = n.parent
        return None

    def edit(self, at: int, remove: int, insert: str) -> None:
        size = self.root.chars
        at = min(max(at, 0), size)
        remove = min(max(remove, 0), size - at)
        if not remove and not insert:
            return
        i, a = self.find(at)
        if i is None:
            self._put(self.root, 0, insert)
            return
        j, b = self.find(at + remove)
        before, after = i.text[:a], j.text[b:]
        first, last = i, j
        if not _CUT.search(i.text, 0, max(a - 1, 0)) and (more := self._beside(i, -1)) is not None:
            first, before = more, more.text + before  # the edit may touch the leaf's first unit
        if not _CUT.search(j.text, min(b + 1, len(j.text))) and (more := self._beside(j, 1)) is not None:
            last, after = more, after + more.text
        gone = first
        while gone is not last:  # all leaves of the stretch but its first one go
            gone = self._beside(first, 1)
            self._take_out(gone)
        parent = first.parent
        place = parent.children.index(first)
        del parent.children[place]
        self._put(parent, place, before + insert + after)

    def _take_out(self, leaf: _Node) -> None:
        n = leaf
        while n.parent is not None:
            parent = n.parent
            parent.children.remove(n)
            if parent.children:
                self._up(parent)
                return
            n = parent
        self._sum(n)  # the text is empty now

    def _up(self, node: _Node | None) -> None:
        while node is not None:
            self._sum(node)
            node = node.parent

    def _put(self, parent: _Node, place: int, stretch: str) -> None:
        """Puts the leaves of a stretch among the children of a node, which is split as often as needed."""
        self.encoded += len(stretch)
        at = cut_units(stretch)
        if 1 < len(at) <= 2 * LEAF + 1:
            new = [_Node(stretch, len(self.encode(stretch)), len(at) - 1)]
        else:
            new = self._leaves(stretch, at)
        for n in new:
            n.parent = parent
        parent.children[place:place] = new
        if not parent.children:
            if parent.parent is not None:
                self._take_out(parent)
                return
            self._sum(parent)
            return
        while len(parent.children) > FANOUT:
            cut = [parent.children[k : k + FANOUT // 2] for k in range(0, len(parent.children), FANOUT // 2)]
            if parent.parent is None:
                parent.children = [self._inner(c) for c in cut]
                for c in parent.children:
                    c.parent = parent
                continue
            above, k = parent.parent, parent.parent.children.index(parent)
            parts = [self._inner(c) for c in cut]
            for c in parts:
                c.parent = above
            above.children[k : k + 1] = parts
            parent = above
        self._up(parent)


@lean
def _count(batches, path: str, special: bool):
    units_of, encode = UnitEncoder(path, special), encode_with(encoder(path, special))
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        edits = batch.column("edits")
        for lo, hi, d, o in slices(data, offs):
            starts, first, sizes = unit_sizes(units_of, d, o)
            chars = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
            fine = plain(d, o, units_of.odd)
            raw = d.tobytes()
            rows = []
            for k in range(hi - lo):
                a, b = int(first[k]), int(first[k + 1])
                text = raw[o[k] : o[k + 1]].decode("utf-8", "replace")
                if fine[k] and b > a:
                    at = chars[starts[a:b]] - chars[o[k]]
                    tree = TokenTree(text, encode, [*at.tolist(), len(text)], sizes[a:b])
                else:
                    tree = TokenTree(text, encode)
                before, n = tree.total, 0
                for e in edits[lo + k].as_py() or ():
                    if e is not None and (e["at"] is not None or e["insert"] is not None):
                        tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                        n += 1
                rows.append((before, n, tree.total, len(tree.leaves()), tree.encoded))
            names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_leaves", "n_chars_encoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]], names)


def count_tokens(docs: DataFrame, edits: str = "edits", tokenizer: str | None = None, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: its tokens, the tokens after its edits, the leaves, and the code points that edits encoded.

    edits: name of a column of arrays of struct(at, remove, insert), applied in order.
    special: the string of a special token in a text is that token, else ordinary text."""
    small_batches(docs.sparkSession)
    path = str(tokenizer or public_tokenizers.path(DEFAULT))
    kind = "array<struct<at: bigint, remove: bigint, insert: string>>"
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits).cast(kind).alias("edits"))
    return docs.mapInArrow(partial(_count, path=path, special=special), RESULT)
