"""Substring deduplication behind a distributed count-min sketch.

Documents are dealt to chunks of a few megabytes. The method is:

1. Sketch. Each chunk hashes its windows of `size` consecutive words to one column
   in each of `DEPTH` rows of a count-min sketch and sends the columns it uses, as
   sorted packed arrays, to the tasks that own them. An owner merges the counts of
   all chunks over its range of columns and answers each chunk with those of its
   columns that count two documents or more. Counts may be too large (columns are
   shared), never too small, so no repeated window is lost. The sketch has columns in
   proportion to the corpus, as one of a fixed width would take every window of a large corpus for
   repeated, and is nowhere in one place: nothing is broadcast. A window costs some two
   bytes for each row of the sketch.
2. Exact. Windows whose columns are repeated in every row are grouped by a 96-bit hash,
   one row for each window and chunk with the smallest document there. The answer is
   a bit: some other chunk has a smaller document.
3. Each chunk removes the words of windows that start in a smaller document.

A window that stands in a third of all documents is one entry for each chunk, so no
group holds a third of the rows. A task has several chunks, one in memory at a time. Windows are told apart by 96 bits of hash.

Nulls: a null text has no words. A null doc_id neither removes words nor loses any.
Rows that repeat a doc_id are one document in comparisons, and each gives a result.
Texts shorter than a window lose nothing. An empty table gives an empty result.
Columns other than the two named are not read by the operator.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import first_of_runs, lean, member, pack, pack_sorted, quoted, settled, slices_of_runs, small_batches, unpack, unpack_sorted
from .words import NOT_SPACE, WordHash, cuts, hashed_words, scan, utf8, window_hash, window_starts

WINDOW = 13
DEPTH = 2
CHUNK_BYTES = 4 << 20
RANGE_BITS = 22, 28  # of the columns that one task owns, from small corpora to large ones
CHUNKS, MOST_TASKS = 4, 20_000  # chunks of a task, which has one of them in memory at a time; more beyond so many tasks
_HASH = WordHash(4)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ODD = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)

PART = "chunk int, row int, shard int, cols binary, more binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def plan(n_bytes: int, parallel: int = 8) -> dict:
    """Chunks, tasks, sketch columns and shards for so many bytes of text and tasks at once.

    Columns grow with the corpus. So do, by a root of it, chunks and the columns that a task owns: a chunk
    then has enough windows for each shard of the sketch that packing them is worth it. At 100 TB these are 3 million chunks of 32 MB in
    20,000 tasks, 2^46 columns in 2^18 shards, and some 20 windows of a chunk in each."""
    width = max(16, math.ceil(math.log2(max(1, n_bytes) / 6 * 4)))  # about 4 columns for each word
    low, high = RANGE_BITS
    span = min(width - 3, max(low, min(high, (width + 10) // 2)))
    chunks = max(32, math.ceil(n_bytes / (CHUNK_BYTES << max(0, min(3, (width - 34) // 4)))))
    tasks = min(chunks, MOST_TASKS, max(2 * parallel, math.ceil(chunks / CHUNKS)))
    return {"chunks": chunks, "tasks": tasks, "width": width, "range": span, "exact": max(3, width - span)}


def _windows(texts, ids, size: int):
    """Word hashes, first words, window starts, each window's document as rank of its id, and the ids."""
    data, offs = utf8(texts)
    h, first = hashed_words(data, offs, NOT_SPACE, _HASH)
    at = window_starts(first, size)
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.searchsorted(first, at, "right") - 1
    keep = known[rows]
    at, rows = at[keep], rows[keep]
    distinct, rank = np.unique(ids, return_inverse=True)
    return data, offs, h, first, at, rows, rank[rows].astype(np.uint64), distinct


def _column(x: np.ndarray, row: int, width: int) -> np.ndarray:
    return (x * np.uint64(_ODD[row])) >> np.uint64(64 - width)


def _arrays(table: pa.Table):
    table = table.combine_chunks()
    one = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)
    return one(table["text"]), one(table["doc_id"])


@lean
def _sketch(key, docs: pa.Table, size: int, p: dict) -> pa.Table:
    """Of a chunk: the columns of its windows, and which of them have two documents in the chunk."""
    texts, ids = _arrays(docs)
    _, _, h, _, at, _, rank, distinct = _windows(texts, ids, size)
    x, chunk = window_hash(h, at, size), key[0].as_py()
    bits = np.uint64(max(1, int(len(distinct) - 1).bit_length()))
    rows = []
    for row in range(DEPTH) if len(x) else ():
        col = _column(x, row, p["width"])
        if p["width"] + int(bits) <= 64:
            both = np.sort((col << bits) | rank)
            col, doc = both >> bits, both & ((np.uint64(1) << bits) - np.uint64(1))
        else:
            order = np.lexsort((rank, col))
            col, doc = col[order], rank[order]
        run = first_of_runs(col)
        last = np.append(run[1:], len(col)) - 1
        cols, two = col[run], doc[run] != doc[last]
        shard = cols >> np.uint64(p["range"])
        for a, b in slices_of_runs(shard):
            rows.append((chunk, row, int(shard[a]), pack_sorted(cols[a:b]), pack(np.packbits(two[a:b]))))
    return pa.Table.from_batches([_batch(rows)])


def _batch(rows) -> pa.RecordBatch:
    names, kinds = ("chunk", "row", "shard", "cols", "more"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


@lean
def _merge(table: pa.Table, p: dict) -> pa.Table:
    """One shard of the sketch: the counts of all chunks, and each chunk's columns that count two or more."""
    row, shard = table["row"][0].as_py(), table["shard"][0].as_py()
    base = np.uint64(shard << p["range"])
    counts = np.zeros(1 << p["range"], np.uint8)
    blobs = table.select(["chunk", "cols", "more"]).to_pylist()
    for b in blobs:
        cols = (unpack_sorted(b["cols"]) - base).astype(np.int64)
        two = np.unpackbits(unpack(b["more"], np.uint8), count=len(cols))
        counts[cols] = np.minimum(counts[cols] + 1 + two, 2)
    rows = []
    for b in blobs:
        cols = unpack_sorted(b["cols"])
        cols = cols[counts[(cols - base).astype(np.int64)] >= 2]
        if len(cols):
            rows.append((b["chunk"], row, shard, pack_sorted(cols), None))
    return pa.Table.from_batches([_batch(rows)])


def _candidates(docs: pa.Table, replies: pa.Table, size: int, p: dict):
    """Windows estimated repeated, in the order of their exact keys."""
    texts, ids = _arrays(docs)
    data, offs, h, first, at, rows, rank, distinct = _windows(texts, ids, size)
    x = window_hash(h, at, size)
    reps = replies.to_pylist()
    for row in range(DEPTH):
        blobs = sorted((r["shard"], r["cols"]) for r in reps if r["row"] == row)
        repeated = np.concatenate([unpack_sorted(b) for _, b in blobs]) if blobs else np.zeros(0, np.uint64)
        keep = member(_column(x, row, p["width"]), repeated)
        x, at, rows, rank = x[keep], at[keep], rows[keep], rank[keep]
    y = (window_hash(h, at, size, _BASES[1]) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((rank, y, x))
    x, y, at, rows, rank = x[order], y[order], at[order], rows[order], rank[order].astype(np.int64)
    run = first_of_runs(x, y)
    return (data, offs, first, rows), (x, y, at, rank), run, distinct


@lean
def _exact(key, docs: pa.Table, replies: pa.Table, size: int, p: dict) -> pa.Table:
    """Of each chunk: the distinct windows estimated repeated, with the smallest doc_id there."""
    out = []
    if docs.num_rows and replies.num_rows:
        _, (x, y, _, rank), run, distinct = _candidates(docs, replies, size, p)
        x, y, least = x[run], y[run], distinct[rank[run]]
        shard = x >> np.uint64(64 - p["exact"])
        for a, b in slices_of_runs(shard):
            blob = pack(y[a:b]), pack(least[a:b])
            out.append((key[0].as_py(), len(blob[0]), int(shard[a]), pack_sorted(x[a:b]), blob[0] + blob[1]))
    return pa.Table.from_batches([_batch(out)])


@lean
def _smallest(table: pa.Table) -> pa.Table:
    """Exact groups of one shard: to each chunk, a bit for each of its windows that has a smaller document elsewhere."""
    blobs = table.to_pylist()
    xs = [unpack_sorted(b["cols"]) for b in blobs]
    ys = [unpack(b["more"][: b["row"]], np.uint32) for b in blobs]
    own = [unpack(b["more"][b["row"] :], np.int64) for b in blobs]
    x, y, d = np.concatenate(xs), np.concatenate(ys), np.concatenate(own)
    order = np.lexsort((y, x))
    run = first_of_runs(x[order], y[order])
    least = np.repeat(np.minimum.reduceat(d[order], run), np.diff(np.append(run, len(x))))
    smaller = np.empty(len(x), bool)
    smaller[order] = least < d[order]
    ends = np.cumsum([len(v) for v in xs])
    rows = [(b["chunk"], -1, b["shard"], None, np.packbits(smaller[e - len(v) : e]).tobytes()) for b, v, e in zip(blobs, xs, ends, strict=True)]
    return pa.Table.from_batches([_batch(rows)])


@lean
def _remove(key, docs: pa.Table, replies: pa.Table, size: int, p: dict, text: bool) -> pa.Table:
    """The result of each document of a chunk."""
    if not docs.num_rows:
        empty = docs.drop_columns(["doc_id", "text", "chunk"])
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string()), "kept": pa.array([], pa.string())} | {c: empty[c] for c in empty.column_names})
    sketch = replies.filter(pc.greater_equal(replies["row"], 0))
    (data, offs, first, _), (x, y, at, rank), run, _ = _candidates(docs, sketch, size, p)
    ux = x[run]
    shard = (ux >> np.uint64(64 - p["exact"])).astype(np.int64)
    answers = {r["shard"]: r["more"] for r in replies.to_pylist() if r["row"] == -1}
    smaller = np.zeros(len(ux), bool)
    for a, b in slices_of_runs(shard):
        smaller[a:b] = np.unpackbits(np.frombuffer(answers[int(shard[a])], np.uint8), count=b - a)
    of = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(x))))
    gone = at[smaller[of] | (rank > rank[run][of])]
    cover = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(cover, gone, 1)
    np.add.at(cover, np.minimum(gone + size, len(cover) - 1), -1)
    removed = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(removed)])
    n_removed = total[first[1:]] - total[first[:-1]]
    digests, kept = [], []
    texts, ids = _arrays(docs)
    for lo, hi in cuts(offs, 1 << 20):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        for k, words in enumerate(kept_words(d, o, removed[first[lo] : first[hi]])):
            digests.append(hashlib.sha256(words).hexdigest())
            kept.append(None if not text else words.decode("utf-8", "replace") if n_removed[lo + k] else texts[lo + k].as_py())
    more = docs.drop_columns(["doc_id", "text", "chunk"])
    return pa.table({"doc_id": ids, "n_words": pa.array(np.diff(first)), "n_removed": pa.array(n_removed), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.string())} | {c: more[c] for c in more.column_names})


def kept_words(data: np.ndarray, offs: np.ndarray, removed: np.ndarray):
    """Each row's words that are not removed, joined by one space."""
    starts, ends, _ = scan(data, offs, NOT_SPACE)
    n = len(data)
    flag = np.zeros(n + 2, np.int8)
    flag[starts[~removed]] = 1
    flag[ends[~removed]] -= 1
    keep = np.cumsum(flag)[:n] > 0
    after = ends[~removed]
    after = after[(after < n)]
    after = after[~NOT_SPACE[data[after]]]
    keep[after] = True
    out = np.where(NOT_SPACE[data], data, np.uint8(0x20))[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[offs]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield out[a:b].strip(b" ")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, text: bool = True, rest: list[str] | None = None) -> DataFrame:
    """Of each document: n_words, n_removed, kept_sha256 (of the kept words joined by one space), and with `text` kept:
    the kept words joined by one space, the text as it is where nothing was removed; else null.
    rest: columns of docs that the column `rest`, a struct, carries along."""
    more = [F.struct(*[quoted(c).alias(c) for c in rest]).alias("rest")] if rest else []
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"), *more)
    result = StructType.fromDDL(RESULT)
    if rest:
        result.add("rest", docs.schema["rest"].dataType)
    small_batches(docs.sparkSession)
    docs = settled(docs)
    p = plan(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, docs.sparkSession.sparkContext.defaultParallelism)
    # rows are dealt by place in the input, not by value: any number of equal rows spreads over all chunks, and tasks have equally many chunks
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(p["chunks"])).cast("int")
    chunked = docs.withColumn("chunk", chunk).repartitionById(p["tasks"], "chunk")
    sent = chunked.groupBy("chunk").applyInArrow(lambda key, t: _sketch(key, t, size, p), PART)
    owner = (F.col("row") * (1 << (p["width"] - p["range"])) + F.col("shard")).cast("int")
    owned = sent.withColumn("owner", owner).repartitionById(p["tasks"], "owner")
    repeated = owned.groupBy("owner").applyInArrow(lambda t: _merge(t, p), PART)
    repeated = repeated.repartitionById(p["tasks"], "chunk")  # one exchange, and one of the texts, serve both readers
    windows = chunked.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(lambda k, a, b: _exact(k, a, b, size, p), PART)
    answers = windows.repartitionById(p["tasks"], "shard").groupBy("shard").applyInArrow(lambda t: _smallest(t), PART)
    replies = repeated.unionByName(answers).repartitionById(p["tasks"], "chunk")
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda k, a, b: _remove(k, a, b, size, p, text), result)
