"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are `SHINGLE` consecutive words (a shorter text is one shingle). A shingle that
stands n times in the text weighs (1 + ln n) * (1 + DAMPING * ln(min(N / df, RARE)) / ln(RARE)),
so that a line repeated often doesn't outweigh the rest of two texts. df
comes from a count-min sketch of fixed size over all documents. The error of such a
sketch is a fixed share of N, and weights level off at df = N / RARE, so the sketch
serves at every corpus size. So a shingle in few documents weighs 1 + DAMPING times one that is in all.
The damping keeps copies in large groups similar: without it a shingle that a large group
shares would hardly weigh against a changed one.

1. sketch: df of all shingles of all documents; pieces of the sketch are summed in Spark.
2. sign: BANDS * ROWS samples of each text; a band is the hash of ROWS samples. Equal
   weighted sets have equal samples, and a sample agrees with the probability of the
   weighted Jaccard similarity. At 0.8 a pair misses all 18 bands of 5 with probability 8e-4.
3. Exact copies (equal MD5 of the text) are one node from here on, their smallest doc_id.
4. Buckets with two nodes or more, without those whose set of nodes is another bucket's.
5. verify: the weighted sets of a bucket's nodes meet in one task, which compares them
   exactly and returns at most one row for each node, its smallest connected one. Pairs that are connected
   already are skipped, and so are those that can't be similar: in order from the bucket's rarest shingle on,
   two similar texts share one of those that make up the first fifth of either's weight. So texts that
   only share what the whole bucket shares aren't compared. Buckets of over BLOCK shingles are split
   into blocks; each pair of blocks is a task of its own, so memory is bounded and no pair is left out.
6. Connected components by alternating stars, written to the shared folder in each step.

Nulls: a null text or a null doc_id is in a class of its own (class_id is its doc_id).
Texts without words: equal texts are one class. Rows that repeat a doc_id each give a
result, and join their texts' classes. An empty table gives an empty result. Other
columns are not read.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_of_runs, lean, pack, pack_sorted, small_batches, small_side, stored, unpack, unpack_sorted
from .words import NOT_SPACE, WordHash, cuts, hashed_words, utf8, window_hash, window_starts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 18, 5
DAMPING, RARE = 0.5, 256
SKETCH_DEPTH, SKETCH_BITS, PIECES = 2, 19, 16
BLOCK = 1_500_000
SLICE = 1 << 18
_HASH = WordHash(2)
_ODD = np.random.default_rng(22).integers(0, 2**63, (SKETCH_DEPTH + 2 * BANDS * ROWS,), np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = 4096


def _uniform(seed: int) -> np.ndarray:
    """Midpoints of equal shares of (0, 1), in random order."""
    return np.random.default_rng(seed).permutation((np.arange(_TABLE) + 0.5) / _TABLE)


def _gamma(seed: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), in random order: x with 1 - (1 + x) exp(-x) = u, by bisection."""
    u = _uniform(seed)
    lo, hi = np.zeros(_TABLE), np.full(_TABLE, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


_R, _LN_C, _BETA = _gamma(1).astype(np.float32), np.log(_gamma(2)).astype(np.float32), _uniform(3).astype(np.float32)
_ONE_R = 1 / _R


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE):
    """Distinct shingles of each row: hashes in ascending order within the row, counts, and each row's first."""
    h, first = hashed_words(data, offs, NOT_SPACE, _HASH)
    at = window_starts(first, size)
    x = window_hash(h, at, size)
    row = np.searchsorted(first, at, "right") - 1
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        acc = np.array([_short(h[first[k] : first[k + 1]]) for k in short], np.uint64)
        x, row = np.concatenate([x, acc]), np.concatenate([row, short])
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    run = first_of_runs(row, x)
    count = np.diff(np.append(run, len(x)))
    return x[run], count, np.searchsorted(row[run], np.arange(len(n) + 1))


def _short(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")


def _cells(x: np.ndarray, depth: int) -> np.ndarray:
    return ((x * _ODD[depth]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


@lean
def _sketch(batches):
    sketch = np.zeros((SKETCH_DEPTH, 1 << SKETCH_BITS), np.int64)
    rows = 0
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for lo, hi in cuts(offs, SLICE):
            x, _, _ = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            for d in range(SKETCH_DEPTH):
                sketch[d] += np.bincount(_cells(x, d), minlength=1 << SKETCH_BITS)
        rows += batch.num_rows
    if rows:
        names = ["piece", "rows", "cells"]
        for k, part in enumerate(np.split(sketch.reshape(-1), PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rows], pa.int64()), pa.array([pack(part)], pa.binary())], names)


@lean
def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_DEPTH * (1 << SKETCH_BITS) // PIECES, np.int64)
    for b in table["cells"].to_pylist():
        total += unpack(b, np.int64)
    piece = table["piece"][0].as_py()
    return pa.table({"piece": pa.array([piece], pa.int32()), "rows": pa.array([sum(table["rows"].to_pylist())], pa.int64()), "cells": pa.array([pack(total)], pa.binary())})


def shingle_weights(docs: DataFrame) -> np.ndarray:
    """ln of the weight factor for each cell of the sketch: SKETCH_DEPTH * 2**SKETCH_BITS float32 numbers at any corpus size."""
    kind = "piece int, rows long, cells binary"
    parts = docs.select("text").mapInArrow(_sketch, kind).withColumn("salt", F.pmod(F.monotonically_increasing_id().bitwiseAND(0x7FFFFFFFFFFFFFFF) / (1 << 33), F.lit(64)).cast("int"))
    some = parts.groupBy("piece", "salt").applyInArrow(lambda t: _sum(t), kind)
    rows = some.groupBy("piece").applyInArrow(lambda t: _sum(t), kind).collect()  # PIECES rows of fixed size
    out = np.zeros((PIECES, SKETCH_DEPTH * (1 << SKETCH_BITS) // PIECES))
    n = 0
    for r in rows:
        out[r["piece"]] = unpack(bytes(r["cells"]), np.int64)
        n = r["rows"]
    share = np.clip(n / np.maximum(out, 1), 1, RARE)
    return (1 + DAMPING * np.log(share) / math.log(RARE)).astype(np.float32).reshape(SKETCH_DEPTH, -1)


def weights(x: np.ndarray, count: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """TF-IDF weights with sublinear counts; the largest factor is that of the smallest, so least overestimated, df."""
    f = factors[0][_cells(x, 0)]
    for d in range(1, SKETCH_DEPTH):
        f = np.maximum(f, factors[d][_cells(x, d)])
    return (f * (1 + np.log(count))).astype(np.float32)


def samples(x: np.ndarray, w: np.ndarray, first: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n consistent weighted samples of each row (32 bits of hash of shingle and step); 0 for rows without shingles.

    Of a row's shingles the one with the smallest ln(a) is sampled, of equal ones that with the smallest hash, as rows are
    in order of hash. Arrays are made once and filled anew for each sample."""
    out = np.zeros((n, len(first) - 1), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    at, lw = first[:-1][full], np.log(w)
    place, low, mask = np.arange(len(x), dtype=np.uint64), np.uint64(0xFFFFFFFF), np.int64(_TABLE - 1)
    y, z, key = np.empty_like(x), np.empty_like(x), np.empty(len(x), np.uint64)
    index = z.view(np.int64)
    r, t, beta, ln_a = (np.empty(len(x), np.float32) for _ in range(4))

    def look_up(table: np.ndarray, shift: int, into: np.ndarray) -> None:
        np.right_shift(y, np.uint64(shift), out=z)
        np.bitwise_and(index, mask, out=index)
        np.take(table, index, out=into, mode="clip")

    for j in range(n):
        k = SKETCH_DEPTH + n + j
        np.multiply(x, _ODD[SKETCH_DEPTH + j], out=y)
        np.right_shift(y, np.uint64(29), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, _ODD[k] if k < len(_ODD) else np.uint64(0xD6E8FEB86659FD93), out=y)
        look_up(_R, 52, r)
        np.take(_ONE_R, index, out=t, mode="clip")
        look_up(_BETA, 40, beta)
        t *= lw
        t += beta
        np.floor(t, out=t)  # the step of the weight
        beta -= t
        beta -= np.float32(1)
        beta *= r
        look_up(_LN_C, 28, ln_a)
        ln_a += beta
        ln_a += np.float32(64)  # positive, so that its bits are in order
        np.maximum(ln_a, np.float32(0), out=ln_a)
        key[:] = ln_a.view(np.uint32)
        key <<= np.uint64(32)
        key |= place
        best = (np.minimum.reduceat(key, at) & low).astype(np.int64)
        h = y[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[j, full] = (h >> np.uint64(32)).astype(np.uint32)
    return out


SIGNED = "doc_id long, text_key binary, n long, bands array<bigint>"


@lean
def _sign(batches, factors):
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        known = np.asarray(batch.column("text").is_valid())
        for lo, hi in cuts(offs, SLICE):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            x, count, first = shingles(d, o)
            sig = samples(x, weights(x, count, factors.value), first)
            n = np.diff(first)
            raw = d.tobytes()
            keys = [hashlib.md5(raw[a:b]).digest() if k else None for a, b, k in zip(o[:-1], o[1:], known[lo:hi], strict=True)]
            band = np.zeros((hi - lo, BANDS), np.uint64)
            for b in range(BANDS):
                acc = np.full(hi - lo, b + 1, np.uint64)
                for s in sig[b * ROWS : (b + 1) * ROWS]:
                    acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + s
                acc ^= acc >> np.uint64(33)
                acc *= np.uint64(0xC2B2AE3D27D4EB4F)
                band[:, b] = acc ^ (acc >> np.uint64(29))
            flat = pa.array(band[n > 0].reshape(-1).view(np.int64))
            sizes = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)],
                ["doc_id", "text_key", "n", "bands"],
            )


@lean
def _sets(batches, factors):
    """The weighted set of each text: 40 bits of each shingle's hash, ascending, and float32 weights."""
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for lo, hi in cuts(offs, SLICE):
            x, count, first = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            w = weights(x, count, factors.value)
            x = x >> np.uint64(24)
            blobs = [(pack_sorted(x[a:b]), pack(w[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]
            own = [batch.column(c).slice(lo, hi - lo) for c in ("node", "text_key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.binary())], ["node", "text_key", "x", "w"])


def _prefixes(code: np.ndarray, flat: np.ndarray, begin: np.ndarray, ends: np.ndarray, total: np.ndarray, similarity: float):
    """For each node the shingles, rarest in the bucket first, that make up more than 1 - similarity of its weight, as
    runs (code, node) in order of node, and the nodes of each code: nodes without a common one aren't similar."""
    often = np.bincount(code)
    node = np.repeat(np.arange(len(begin)), ends - begin)
    order = np.lexsort((code, often[code], node))
    c, w = code[order], flat[order]
    before = np.cumsum(w) - w
    before -= before[begin][node]
    keep = before <= (1 - similarity) * total[node] * (1 + 1e-6) + 1e-9
    c, node = c[keep], node[keep]
    first = np.searchsorted(node, np.arange(len(begin) + 1))
    by = np.argsort(c, kind="stable")
    return c, first, node[by], np.searchsorted(c[by], np.arange(len(often) + 1))


def links_of(nodes: np.ndarray, x: list[np.ndarray], w: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Pairs (smallest node, other node) of the components that a weighted Jaccard similarity of at least `similarity` connects.
    Nodes that are connected already, or can't be similar, aren't compared.

    side: 0 or 1 for each node; then only pairs of different sides are compared."""
    order = np.argsort(nodes, kind="stable")
    nodes, x, w = nodes[order], [x[k] for k in order], [w[k] for k in order]
    side = None if side is None else side[order]
    n = np.array([len(v) for v in x])
    _, code = np.unique(np.concatenate(x), return_inverse=True)
    flat = np.concatenate(w).astype(np.float64)
    ends = np.cumsum(n)
    begin = ends - n
    total = np.add.reduceat(flat, begin)
    group = np.arange(len(nodes))
    vector = np.zeros(int(code.max()) + 1)
    prefix, first, holders, at_code = _prefixes(code, flat, begin, ends, total, similarity)
    for k in range(len(nodes) - 1):
        ask = np.arange(k + 1, len(nodes))
        ask = ask[(group[ask] != group[k]) & (np.minimum(total[ask], total[k]) >= similarity * np.maximum(total[ask], total[k]) * (1 - 1e-6))]
        if side is not None:
            ask = ask[side[ask] != side[k]]
        if not len(ask):
            continue
        near = np.zeros(len(nodes), bool)
        for c in prefix[first[k] : first[k + 1]]:
            near[holders[at_code[c] : at_code[c + 1]]] = True
        ask = ask[near[ask]]
        if not len(ask):
            continue
        own = code[begin[k] : ends[k]]
        vector[own] = flat[begin[k] : ends[k]]
        m = n[ask]
        at = np.arange(int(m.sum())) + np.repeat(begin[ask] - (np.cumsum(m) - m), m)
        both = np.add.reduceat(np.minimum(vector[code[at]], flat[at]), np.cumsum(m) - m)
        vector[own] = 0
        similar = ask[both >= similarity * (total[ask] + total[k] - both) - 1e-6]
        for other in similar:
            if group[other] != group[k]:
                low, high = sorted((group[k], group[other]))
                group[group == high] = low  # nodes ascend, so the smallest index is the smallest node
    return [(int(nodes[g]), int(v)) for v, g in zip(nodes, group, strict=True) if nodes[g] != v]


@lean
def _verify(table: pa.Table, similarity: float) -> pa.Table:
    table = table.combine_chunks()
    nodes = table["node"].to_numpy()
    block = table["block"].to_numpy()
    x = [unpack_sorted(b) for b in table["x"].to_pylist()]
    w = [unpack(b, np.float32) for b in table["w"].to_pylist()]
    two = table["one"][0].as_py() != table["two"][0].as_py()
    out = links_of(nodes, x, w, block if two else None, similarity)
    return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("low")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("low")))
    found = ends.groupBy("v").agg(F.sum("low").alias("n"), F.min("low").alias("least"))
    return found.where("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, class_id (the smallest node connected) for every node of the edges (a, b)."""
    both = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not _are_stars(both):
        # large star: larger neighbours move to the smallest one
        around = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: smaller neighbours and the node itself move to the smallest one
        moved = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))
        both = stored(small.where("a <> b").distinct(), "edges")
    roots = both.select(F.col("b").alias("node"), F.col("b").alias("class_id")).distinct()
    return both.select(F.col("a").alias("node"), F.col("b").alias("class_id")).unionByName(roots)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id and class_id, the smallest doc_id of its class."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    factors = spark.sparkContext.broadcast(shingle_weights(docs))
    signed = stored(docs.mapInArrow(partial(_sign, factors=factors), SIGNED), "signed")
    nodes = stored(signed.where("text_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    entries = nodes.select("node", "n", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("set")).where("members > 1")
    kept = buckets.groupBy("set", "members").agg(F.min("band").alias("band"), F.first("total").alias("total"))
    member = stored(entries.join(kept.select("band", F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks")), "band"), "members")
    wanted = member.select("node").distinct()
    texts = small_side(stored(nodes.select("text_key", "node").join(wanted, "node", "left_semi"), "wanted"))
    own = docs.join(texts.select(F.col("node").alias("doc_id"), "node", "text_key"), "doc_id").where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("text_key"))
    sets = stored(own.select("node", "text_key", "text").mapInArrow(partial(_sets, factors=factors), "node long, text_key binary, x binary, w binary"), "sets")
    sets = sets.dropDuplicates(["node", "text_key"]).drop("text_key")  # a doc_id with several texts is one node with several sets
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("one"), F.greatest(k, F.col("block")).alias("two")))
    tasks = member.select("node", "band", "block", F.explode(pairs).alias("p")).select("node", "band", "block", "p.one", "p.two")
    met = tasks.join(sets, "node")
    edges = met.groupBy("band", "one", "two").applyInArrow(lambda t: _verify(t, similarity), "a long, b long")
    found = components(stored(edges, "links"))
    of_text = nodes.select("text_key", "node").join(found, "node", "left").select("text_key", F.coalesce("class_id", "node").alias("class_id"))
    # rows that share a doc_id but not a text
    several = signed.where("text_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text_key").alias("one"), F.max("text_key").alias("two")).where("one <> two")
    if not several.isEmpty():
        twins = signed.join(several, "doc_id", "left_semi").join(of_text, "text_key").select("doc_id", F.col("class_id").alias("b"))
        tied = twins.groupBy("doc_id").agg(F.min("b").alias("a")).join(twins, "doc_id").select("a", "b")
        merged = components(tied)
        of_text = of_text.join(merged.select(F.col("node").alias("class_id"), F.col("class_id").alias("root")), "class_id", "left").select("text_key", F.coalesce("root", "class_id").alias("class_id"))
    return signed.select("doc_id", "text_key").join(of_text, "text_key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
