"""Concatenate and cut: documents laid end to end and cut into windows of `size` tokens.

1. Every task encodes its documents, adds the end id to each, and stores the ids with the
   task's number and the document's offset in the task (a running sum).
2. The tasks' totals, one number each, are summed in task order into global offsets.
3. Each stored document is cut at the multiples of `size`; sequence and offset follow
   from the global offset. A document that crosses a cut gives boundary records.

Nothing is shuffled, and only the last sequence can be short, so there is no other padding.
The stored table fixes the order, so that tasks that run again give the same pieces.
The totals are as many numbers as tasks wrote the table.

Nulls: a null text is empty: the end id alone. A null doc_id stays null in the result.
Texts of any length are encoded whole and cut. Repeated rows are packed each. An empty
table gives no pieces. Other columns are not read.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT, UnitEncoder, encoded, slices
from .shared import FEW_KEYS, lean, pack, small_batches, stored, unpack
from .words import utf8

SIZE = 2048
END = 1
ENCODED = "task long, doc_id long, task_start long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, crosses boolean"


@lean
def _encode(batches, path: str, end: int, special: bool):
    enc = UnitEncoder(path, special)
    task, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for lo, hi, d, o in slices(data, offs):
            ids, row = encoded(enc, d, o)
            n = np.diff(row) + 1
            at = start + np.cumsum(n) - n
            start += int(n.sum())
            blobs = [pack(np.append(ids[a:b], end).astype(np.uint32)) for a, b in zip(row[:-1], row[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, task)), batch.column("doc_id").slice(lo, hi - lo), pa.array(at), pa.array(n), pa.array(blobs, pa.binary())], ["task", "doc_id", "task_start", "doc_tokens", "ids"])


@lean
def _cut(batches, size: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "crosses"]
    for batch in batches:
        begin = batch.column("begin").to_numpy()
        n = batch.column("doc_tokens").to_numpy()
        low, high = begin // size, (begin + n - 1) // size
        count = high - low + 1
        doc = np.repeat(np.arange(len(n)), count)
        seq = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + low[doc]
        a = np.maximum(seq * size, begin[doc])
        b = np.minimum((seq + 1) * size, (begin + n)[doc])
        blobs = batch.column("ids")
        crc, got, last = [], [], -1
        for d, s, e in zip(doc.tolist(), (a - begin[doc]).tolist(), (b - begin[doc]).tolist(), strict=True):
            if d != last:
                ids, last = memoryview(unpack(blobs[d].as_py(), np.uint32).astype("<u4").tobytes()), d
            part = ids[4 * s : 4 * e]
            crc.append(zlib.crc32(part))
            if with_ids:
                got.append(bytes(part))
        cols = [batch.column("doc_id").take(pa.array(doc)), pa.array(a - begin[doc]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(a - seq * size), pa.array(count[doc] > 1)]
        if with_ids:
            cols.append(pa.array(got, pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end: int = END, ids: bool = False, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each piece: doc_id, start and length in its document, ids_crc32, doc_tokens, sequence_id, offset there,
    crosses (its document is cut), and with `ids` the ids as little-endian unsigned 32-bit numbers.
    special: the string of a special token in a text is that token, else ordinary text."""
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(DEFAULT)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = stored(docs.mapInArrow(partial(_encode, path=str(path), end=end, special=special), ENCODED), "encoded")
    spark = docs.sparkSession
    totals = table.groupBy("task").agg(F.max(F.col("task_start") + F.col("doc_tokens")).alias("n")).orderBy("task").collect()
    base = np.concatenate([[0], np.cumsum([r.n for r in totals], dtype=np.int64)])[:-1]
    offsets = spark.createDataFrame([(r.task, int(b)) for r, b in zip(totals, base, strict=True)], "task long, base long")
    offsets = F.broadcast(offsets) if len(totals) <= FEW_KEYS else offsets
    placed = table.join(offsets, "task").select("doc_id", "doc_tokens", "ids", (F.col("base") + F.col("task_start")).alias("begin"))
    return placed.mapInArrow(partial(_cut, size=size, with_ids=ids), PIECES + (", ids binary" if ids else ""))
