"""Merkle manifest of a table: a digest of each row, of each source and of all, and each row's path to the root.

Tree. A row's leaf is the sha256 of its fields, each `-` if null, else UTF-8 byte count, `:` and value. A source's leaves ascend by
doc_id (null first, then by leaf). While there are several nodes, every ARITY consecutive ones, the last run fewer or even one,
become the sha256 of their digests in lower-case hex. Sources, null first, then by bytes, go on the same way to the root.

1. Leaves are computed in the JVM and stored: doc_id, source and digest, but no texts.
2. Ranges of source and doc_id are sorted apart and their counts summed, which gives each leaf its place in its source.
   No task sees a source as a whole.
3. A block is ARITY**HEIGHT = 4,096 aligned places of a source: one row with its leaves, at most some 600 KB. A treehash
   over it gives the block's root. The roots are the leaves of the next tier, which is placed and built the same way, until a
   source has one node; then the sources' roots are.
4. From the top down, each tier's nodes get the path of the block they are in (one join of blocks, not of rows), and the
   traversal of their own block: leaf after leaf it gives the siblings of each level. At each level it holds the run of
   nodes that the leaf is in and a treehash that builds the next run from the leaves ahead, one leaf for each step, so the next run is there when it
   is needed. It holds 2 * ARITY nodes and a stack for each of HEIGHT levels, whatever the block's size.

A path is a list of levels, each with the siblings left and right of the node. Folding a digest along it gives the root, if the digest is the leaf's.

Nulls: any of the columns can be null; a null doc_id comes first in its source. Ties: rows of the same source and doc_id are ordered
by leaf; equal rows have equal leaves, and take their places in any order. Texts of any length are hashed whole. An
empty table has no rows and no root. Other columns are not read, whatever their names. doc_id is ordered as the type it
has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.operators.order import places

from .shared import lean, small_batches, stored

ARITY, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels from a node upwards: the hex digests left and right of it
PATH = "array<struct<left:binary,right:binary>>"


def h(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def leaf(*fields: Column) -> Column:
    """The digest of a row, in lower-case hex."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


class Treehash:
    """Nodes of one level from the leaves below them, which come one by one. Holds at most ARITY nodes of each level below."""

    def __init__(self, level: int):
        self.stack: list[list[bytes]] = [[] for _ in range(level)]
        self.nodes: list[bytes] = []

    def push(self, digest: bytes) -> None:
        for run in self.stack:
            run.append(digest)
            if len(run) < ARITY:
                return
            digest = h(run)
            run.clear()
        self.nodes.append(digest)

    def end(self) -> list[bytes]:
        """The nodes, after runs that are shorter than ARITY have been closed."""
        for k, run in enumerate(self.stack):
            if run:
                digest = h(run)
                run.clear()
                (self.stack[k + 1] if k + 1 < len(self.stack) else self.nodes).append(digest)
        return self.nodes


class _Level:
    """The run of nodes that the present leaf is in, at one level, and the next run, as far as it is built."""

    def __init__(self, level: int, leaves: list[bytes]):
        self.level, self.span = level, ARITY**level
        self.leaves, self.read = leaves, 0
        self.now = self._ahead(self.span * ARITY)
        self.next = Treehash(level)

    def _ahead(self, n: int) -> list[bytes]:
        build = Treehash(self.level)
        for digest in self.leaves[self.read : self.read + n]:
            build.push(digest)
        self.read += n
        return build.end()

    def step(self, at: int) -> None:
        """Goes on to leaf `at`, and takes one leaf ahead into the next run."""
        if self.read < len(self.leaves):
            self.next.push(self.leaves[self.read])
        self.read += 1
        if at % (self.span * ARITY) == 0:
            self.now, self.next = self.next.end(), Treehash(self.level)


def levels_of(n: int, height: int) -> int:
    """Levels until n nodes are one, but `height` at most."""
    k = 0
    while n > 1 and k < height:
        n, k = -(-n // ARITY), k + 1
    return k


def block_root(leaves: list[bytes], levels: int) -> bytes:
    build = Treehash(levels)
    for digest in leaves:
        build.push(digest)
    return build.end()[0]


def paths(leaves: list[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Of each leaf of a block, one after the other: the siblings left and right of it and of the nodes above, level by level."""
    level = [_Level(k, leaves) for k in range(levels)]
    for at in range(len(leaves)):
        out = []
        for v in level:
            if at:
                v.step(at)
            place = at // v.span % ARITY
            out.append((b"".join(v.now[:place]), b"".join(v.now[place + 1 :])))
        yield out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and its path give."""
    for left, right in path:
        digest = h([left, digest, right])
    return digest


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """A row for each block of a tree: tree, block, total (the tier's nodes in the tree) and its nodes in order.
    nodes: tree, place, total, digest, and what else is to stay with a node."""
    rest = [c for c in nodes.columns if c not in ("tree", "place", "total", "digest")]
    rows = nodes.select("tree", F.floor(F.col("place") / size).alias("block"), "total", F.struct("place", "digest", *rest).alias("node"))
    return stored(rows.groupBy("tree", "block").agg(F.any_value("total").alias("total"), F.sort_array(F.collect_list("node")).alias("nodes")), "blocks")


def _digests(blocks, k: int) -> list[bytes]:
    return [d.encode() for d in blocks.column("nodes")[k].values.field("digest").to_pylist()]


@lean
def _roots(batches, height: int):
    for batch in batches:
        found = [block_root(_digests(batch, k), levels_of(n, height)).decode() for k, n in enumerate(batch.column("total").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("tree", "block", "total")], pa.array(found, pa.string())], ["tree", "block", "total", "digest"])


def _build(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each tier, and tree, tier and digest of each tree's last node."""
    tiers, tops, size = [], None, ARITY**height
    while True:
        blocks = _blocks(nodes, size)
        roots = stored(blocks.mapInArrow(partial(_roots, height=height), "tree string, block long, total long, digest string"), "roots")
        done = roots.where(F.col("total") <= size).select("tree", F.lit(len(tiers)).alias("tier"), "digest")
        tops = done if tops is None else tops.unionByName(done)
        tiers.append(blocks)
        open_trees = roots.where(F.col("total") > size)
        if open_trees.isEmpty():
            return tiers, tops
        nodes = open_trees.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / size).alias("total"), "digest")


_ARROW_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
ABOVE = f"path {PATH}, subroot string, root string"


@lean
def _descended(batches, height: int, named: bool):
    """A row for each node of the blocks: tree (or with `named` the node's own name) and block (its place), or with the path to the root."""
    for batch in batches:
        for k in range(batch.num_rows):
            nodes = batch.column("nodes")[k].values
            above = batch.column("path")[k].as_py()
            path = [[{"left": a, "right": b} for a, b in p] + above for p in paths(_digests(batch, k), levels_of(batch.column("total")[k].as_py(), height))]
            again = pa.array([k] * len(nodes))
            tree = nodes.field("name") if named else batch.column("tree").take(again)
            place = pa.array([0] * len(nodes), pa.int64()) if named else nodes.field("place")
            subroot = nodes.field("digest") if named else batch.column("subroot").take(again)
            yield pa.RecordBatch.from_arrays([tree, place, pa.array(path, _ARROW_PATH), subroot, batch.column("root").take(again)], ["tree", "block", "path", "subroot", "root"])


def _under(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The blocks of the first tier with path, subroot and root of what is above them. tops: the same of each tree, by tree and tier."""
    below = None
    for t in reversed(range(len(tiers))):
        above = tops.where(F.col("tier") == t).drop("tier").withColumn("block", F.lit(0).cast("long"))
        rows = tiers[t].join(above if below is None else above.unionByName(below), ["tree", "block"])
        if t:
            below = stored(rows.mapInArrow(partial(_descended, height=height, named=False), f"tree string, block long, {ABOVE}"), "paths")
    return rows


@lean
def _proofs(batches, height: int, with_path: bool):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        for k in range(batch.num_rows):
            nodes, above = batch.column("nodes")[k].values, [(p["left"], p["right"]) for p in batch.column("path")[k].as_py()]
            subroot, root = batch.column("subroot")[k].as_py(), batch.column("root")[k].as_py()
            leaves, claimed = _digests(batch, k), nodes.field("claimed").to_pylist()
            proof, folded, path = [], [], []
            for own, other, p in zip(leaves, claimed, paths(leaves, levels_of(batch.column("total")[k].as_py(), height)), strict=True):
                p += above
                proof.append(hashlib.sha256(b"".join(s for pair in p for s in pair)).hexdigest())
                folded.append(fold(own if other is None else other.encode(), p).decode())
                if with_path:
                    path.append([{"left": a, "right": b} for a, b in p])
            n = len(leaves)
            cols = [nodes.field("doc_id"), nodes.field("digest"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proof), pa.array(folded), pa.array([f == root for f in folded])]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(path, _ARROW_PATH)] if with_path else []), names + ["path"] * with_path)


def manifest(docs: DataFrame, claimed: Column | None = None, path: bool = False, height: int = HEIGHT) -> DataFrame:
    """Of each row: doc_id, leaf, subroot (its source's), root, proof_sha256 (of its path's digests, left to right and upwards),
    folded_root (of the claimed text's leaf and the path), verified (that this is the root), and with `path` the path itself.

    claimed: the text as someone else holds it, null where that is null; by default the row's own. height: levels of a block."""
    small_batches(docs.sparkSession)
    field = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if claimed is None else F.when(~claimed.eqNullSafe(F.col("text")), leaf(*field[:-1], claimed))
    tree = F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("-"))  # null first, then by bytes
    leaves = stored(docs.select(tree.alias("tree"), "doc_id", leaf(*field).alias("digest"), other.alias("claimed")), "leaves")
    placed = places(leaves, ["tree"], [F.col("doc_id"), F.col("digest")], total="total")
    tiers, tops = _build(placed, height)
    sources = places(stored(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots"), [], [F.col("name")], total="total")
    upper, top = _build(sources, height)
    top = top.select("tree", "tier", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_source = stored(_under(upper, top, height).mapInArrow(partial(_descended, height=height, named=True), f"tree string, block long, {ABOVE}"), "sources")
    over = tops.select("tree", "tier").join(of_source.drop("block"), "tree")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", path {PATH}" * path
    return _under(tiers, over, height).mapInArrow(partial(_proofs, height=height, with_path=path), schema)
