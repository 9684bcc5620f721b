"""Benchmark decontamination with a distributed positional inverted index.

index() cuts the documents into segments of a few megabytes and stores for each its
documents, its sorted dictionary of term hashes and its postings: the positions of
each term in the segment, term after term. Segments are independent, so that building
shuffles nothing and a lost task builds its segments again.

search() cuts the benchmark into phrases, distinct ones with the items that have them. Up to BLOCK_PHRASES pairs of phrase and
item are sent to all segments at once. More are dealt, so that memory doesn't grow with the benchmark and the index is read a fixed number
of times: the segments' dictionaries give the benchmark's terms their frequencies, a phrase with a term that no document has goes,
and each other one is joined, by its rarest term, with the segments that have it. A segment gets its phrases in rows of at most some
DEALT, and the items of phrases are joined to what was found. (Dictionaries send only terms that pass a bitmap of
the benchmark's terms, of 2 MB at any size.)

A segment drops phrases of which it lacks a term. For the others the shortest postings list, moved by
the term's place in the phrase, gives the candidate starts; the lists of the other
terms, from the rarest, are intersected with them. What is left are exact matches.
proximity() maps another search over the segments: it keeps the places of the rarest term
around which every term occurs within a number of words. Decontamination doesn't use it.

Terms are told apart by 64 bits of hash. Nulls: a null text has no words; a document
with a null id is judged like any other; an item with a null id marks words as hit but
is neither counted nor listed. Empty texts and items without words match nothing.
Repeated rows of documents each give a result; repeated items count once. An empty
benchmark leaves every document clean.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_of_runs, lean, pack, pack_sorted, shared_dir, slices_of_runs, small_batches, stored, unpack, unpack_sorted
from .words import ALNUM, LOWER, WordHash, cuts, hashed_words, utf8

WINDOW = 13
SEGMENT_BYTES = 2 << 20
BLOCK_PHRASES = 100_000  # with their items, that are sent to all executors: some 10 MB of term hashes; more are dealt
DEALT = 20_000  # phrases of a row that a segment gets
BITMAP = 24  # bits of a term's hash in the bitmap of the benchmark's terms
_HASH = WordHash(7)

INDEX = "segment long, doc_ids array<bigint>, first binary, terms binary, counts binary, positions binary"
FOUND = "segment long, row long, doc_id long, n_words long, spans binary, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def term_hashes(data: np.ndarray, offs: np.ndarray):
    return hashed_words(LOWER[data], offs, ALNUM, _HASH)


def _segment(ids: list, data: np.ndarray, offs: np.ndarray) -> tuple:
    h, first = term_hashes(data, offs)
    order = np.argsort(h, kind="stable")
    run = first_of_runs(h[order])
    counts = np.diff(np.append(run, len(h)))
    return ids, pack_sorted(first.astype(np.uint64)), pack_sorted(h[order][run]), pack(counts.astype(np.uint32)), pack(order.astype(np.uint32))


@lean
def _build(batches):
    segment = TaskContext.get().partitionId() << 33
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in cuts(offs, SEGMENT_BYTES):
            s = _segment(ids.slice(lo, hi - lo).to_pylist(), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((segment, *s), kinds, strict=True)], ["segment", "doc_ids", "first", "terms", "counts", "positions"])
            segment += 1


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all documents, stored in the shared folder; one row for each segment."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    built = docs.mapInArrow(_build, INDEX)
    path = f"{shared_dir(spark)}/postings"
    built.write.parquet(path)
    return spark.read.schema(built.schema).parquet(path)


class Postings:
    """One segment, ready for search."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.first = unpack_sorted(row["first"]).astype(np.int64)
        if not len(self.first):  # a segment without a word
            self.first = np.zeros(len(self.ids) + 1, np.int64)
        self.terms = unpack_sorted(row["terms"])
        self.counts = unpack(row["counts"], np.uint32).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = unpack(row["positions"], np.uint32).astype(np.int64)
        self.row_end = np.repeat(self.first[1:], np.diff(self.first))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Places of terms in the dictionary, -1 for those that don't occur."""
        if not len(self.terms):
            return np.full(h.shape, -1)
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of each term, one after the other, and of which they are."""
        n = self.counts[term]
        of = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[term], n)
        return self.positions[at], of

    def phrases(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of phrases, rows of `words` of which `lengths` terms count: phrase and start."""
        width = words.shape[1] if words.ndim == 2 else 0
        used = np.arange(width)[None, :] < lengths[:, None]
        term = self.lookup(words)
        alive = np.flatnonzero(((term >= 0) | ~used).all(1) & (lengths > 0))
        if not len(alive):
            return alive, alive
        term, used, size = term[alive], used[alive], lengths[alive]
        df = np.where(used, self.counts[np.where(used, term, 0)], np.iinfo(np.int64).max)
        rare = np.argsort(df, axis=1, kind="stable")  # places in the phrase, the rarest term first
        slot = {}
        for a in range(0, len(alive), 4096):
            b = min(a + 4096, len(alive))
            place = rare[a:b, 0]
            starts, of = self.lists(term[np.arange(a, b), place])
            starts = starts - place[of]
            of = of + a
            keep = starts >= 0
            starts, of = starts[keep], of[keep]
            keep = starts + size[of] <= self.row_end[starts]
            starts, of = starts[keep], of[keep]
            for k in range(1, width):
                place = rare[of, k]
                check = k < size[of]
                hit = ~check
                c = np.flatnonzero(check)
                hit[c] = self._has(term[of[c], place[c]], starts[c] + place[c])
                starts, of = starts[hit], of[hit]
                if not len(of):
                    break
            slot[a] = alive[of], starts
        return np.concatenate([v[0] for v in slot.values()]), np.concatenate([v[1] for v in slot.values()])

    def _has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the term stands at the position: bisection within the term's postings list."""
        lo, hi = self.begin[term], self.begin[term + 1]
        end = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            below = open_ & (self.positions[np.minimum(mid, len(self.positions) - 1)] < position)
            lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        ok = lo < end
        ok[ok] = self.positions[lo[ok]] == position[ok]
        return ok

    def near(self, words: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term around which every term stands at most `within` words away, in one document."""
        term = self.lookup(np.unique(words))
        if not len(term) or (term < 0).any():
            return np.zeros(0, np.int64)
        term = term[np.argsort(self.counts[term], kind="stable")]
        at, _ = self.lists(term[:1])
        row = np.searchsorted(self.first, at, "right") - 1
        low, high = np.maximum(at - within, self.first[row]), np.minimum(at + within, self.row_end[at] - 1)
        for t in term[1:]:
            there = self.positions[self.begin[t] : self.begin[t + 1]]
            k = np.searchsorted(there, low)
            ok = (k < len(there)) & (there[np.minimum(k, len(there) - 1)] <= high)
            at, low, high = at[ok], low[ok], high[ok]
        return at


@lean
def _phrases(batches, size: int):
    """Every window of the items' words: its term hashes, and the item."""
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        h, first = term_hashes(data, offs)
        n = np.diff(first)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        for lo, hi in cuts(np.concatenate([[0], np.cumsum(count)]), 1 << 16):
            of = np.repeat(np.arange(lo, hi), count[lo:hi])
            at = np.arange(len(of)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi]) + first[:-1][of]
            length = np.minimum(n[of], size)
            raw = h.tobytes()
            words = [raw[8 * a : 8 * (a + m)] for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column("item_id").take(pa.array(of))], ["words", "item_id"])


def phrases(benchmark: DataFrame, size: int) -> DataFrame:
    """words (term hashes of a window, a shorter item's words being one) and item_id, distinct pairs."""
    return benchmark.where("text IS NOT NULL").mapInArrow(partial(_phrases, size=size), "words binary, item_id string").distinct()


def _with_items(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def _block(rows: list, size: int) -> tuple:
    """Phrases as rows of term hashes with their lengths, and their items as codes into a list of names."""
    lengths = np.array([len(r["words"]) // 8 for r in rows], np.int64)
    words = np.zeros((len(rows), size), np.uint64)
    for k, r in enumerate(rows):
        words[k, : lengths[k]] = np.frombuffer(bytes(r["words"]), np.uint64)
    names = sorted({i for r in rows for i in r["items"]})
    code = {n: k for k, n in enumerate(names)}
    items = [[code[i] for i in r["items"]] for r in rows]
    return words, lengths, items, names


@lean
def _search(batches, shared, every: bool, verdict: bool = False):
    """every: rows for documents without a match as well; verdict: RESULT instead of FOUND."""
    found = _found(batches, shared, every)
    yield from _verdicts(found) if verdict else found


def _found(batches, shared, every: bool):
    words, lengths, of, names = shared.value
    for batch in batches:
        for segment, row in zip(batch.column("segment").to_pylist(), batch.drop_columns(["segment"]).to_pylist(), strict=True):
            p = Postings(row)
            phrase, start = p.phrases(words, lengths)
            doc = np.searchsorted(p.first, start, "right") - 1
            spans: dict[int, np.ndarray] = {}
            items: dict[int, set] = {}
            by = np.argsort(doc, kind="stable")
            for a, b in slices_of_runs(doc[by]):
                some, d = by[a:b], int(doc[by[a]])
                spans[d] = merged(start[some] - p.first[d], lengths[phrase[some]])
                items[d] = {names[i] for g in set(phrase[some].tolist()) for i in of[g]}
            rows = range(len(p.ids)) if every else sorted(spans)
            n_words = np.diff(p.first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment] * len(rows), pa.int64()),
                    pa.array(rows, pa.int64()),
                    pa.array([p.ids[k] for k in rows], pa.int64()),
                    pa.array([n_words[k] for k in rows], pa.int64()),
                    pa.array([spans[k].tobytes() if k in spans else None for k in rows], pa.binary()),
                    pa.array([sorted(items.get(k, ())) for k in rows], pa.list_(pa.string())),
                ],
                ["segment", "row", "doc_id", "n_words", "spans", "items"],
            )


@lean
def _near(batches, sets, within: int):
    sets = [(name, term_hashes(*utf8(pa.array([text])))[0]) for name, text in sets]
    for batch in batches:
        for row in batch.to_pylist():
            p = Postings(row)
            rows = []
            for name, words in sets:
                at = p.near(words, within)
                doc = np.searchsorted(p.first, at, "right") - 1
                rows += [(p.ids[d], name, int(x)) for d, x in zip(doc.tolist(), at - p.first[doc], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["doc_id", "terms", "position"])


def proximity(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id, terms, position (in words, from 0): for each text of `terms`, the places in a document around which each of
    its words stands at most `within` words away. A place is one of the word that is rarest in the document's segment.
    A text without words is nowhere."""
    return index.mapInArrow(partial(_near, sets=[(t, t) for t in dict.fromkeys(terms)], within=within), "doc_id long, terms string, position long")


def merged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The union of intervals as rows (start, end), in order and apart."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return np.stack([a[at], b[np.append(at[1:], len(a)) - 1]], 1).astype(np.int64)


def _pairs(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """The benchmark's phrases with their items, stored, and whether they are few enough to be sent to all segments."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    pairs = stored(phrases(items, size), "phrases")
    return pairs, pairs.count() <= BLOCK_PHRASES


def _sent(index: DataFrame, pairs: DataFrame, size: int):
    return index.sparkSession.sparkContext.broadcast(_block(_with_items(pairs).collect(), size))


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Of each document: its words, the merged spans (pairs of 64-bit integers) of words in windows of items, and these items."""
    small_batches(index.sparkSession)
    pairs, few = _pairs(benchmark, size, item_col, text_col)
    if not few:
        return _dealt_search(index, pairs, size)
    shared = _sent(index, pairs, size)
    found = stored(index.mapInArrow(partial(_search, shared=shared, every=True), FOUND), "found")
    shared.destroy()
    return found


@lean
def _terms(batches):
    """The distinct terms of each phrase, with their number."""
    for batch in batches:
        found = [np.unique(np.frombuffer(w, np.uint64)) for w in batch.column("words").to_pylist()]
        n = np.array([len(f) for f in found], np.int64)
        of = pa.array(np.repeat(np.arange(len(n)), n))
        term = np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("words").take(of), pa.array(term), pa.array(np.repeat(n, n))], ["words", "term", "n_terms"])


@lean
def _dictionary(batches, bitmap):
    """The terms of each segment that pass the bitmap, with their number of postings."""
    for batch in batches:
        for row in batch.to_pylist():
            term, n = unpack_sorted(row["terms"]), unpack(row["counts"], np.uint32).astype(np.int64)
            bit = (term >> np.uint64(64 - BITMAP)).astype(np.int64)
            keep = np.flatnonzero((bitmap.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(term[keep].view(np.int64)), pa.array(np.full(len(keep), row["segment"], np.int64)), pa.array(n[keep])], ["term", "segment", "n"])


def _bitmap(terms: DataFrame) -> np.ndarray:
    """A bit for each value of the first BITMAP bits of the terms' hashes: 2 MB, put together by Spark in parts of 4 KB."""
    bit = F.call_function("shiftrightunsigned", "term", F.lit(64 - BITMAP)) + 1
    parts = terms.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(1 << (BITMAP - 3), np.uint8)
    for r in parts.collect():
        out[(r.part - 1) * len(r.bits) :][: len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


@lean
def _dealt(batches, size: int):
    """Of the documents with matches of a row's phrases: their spans, and these phrases."""
    for batch in batches:
        for segment, row in zip(batch.column("segment").to_pylist(), batch.drop_columns(["segment"]).to_pylist(), strict=True):
            p, names = Postings(row), row["phrases"]
            words, lengths, _, _ = _block([{"words": w, "items": ()} for w in names], size)
            phrase, start = p.phrases(words, lengths)
            doc = np.searchsorted(p.first, start, "right") - 1
            by = np.argsort(doc, kind="stable")
            rows, spans, found = [], [], []
            for a, b in slices_of_runs(doc[by]):
                some, d = by[a:b], int(doc[by[a]])
                rows.append(d)
                spans.append(merged(start[some] - p.first[d], lengths[phrase[some]]).tobytes())
                found.append([names[g] for g in np.unique(phrase[some]).tolist()])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(([segment] * len(rows), rows, spans, found), kinds, strict=True)], ["segment", "row", "spans", "phrases"])


@lean
def _rows(batches):
    """Every document of the segments."""
    for batch in batches:
        for row in batch.to_pylist():
            n = np.diff(unpack_sorted(row["first"]).astype(np.int64))
            ids = row["doc_ids"]
            n = n if len(n) else np.zeros(len(ids), np.int64)  # a segment without a word
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["segment"], np.int64)), pa.array(np.arange(len(ids))), pa.array(ids, pa.int64()), pa.array(n)], ["segment", "row", "doc_id", "n_words"])


def _dealt_search(index: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """As the search with phrases sent to all segments, for any number of them."""
    terms = stored(pairs.select("words").distinct().mapInArrow(_terms, "words binary, term long, n_terms long"), "terms")
    bitmap = index.sparkSession.sparkContext.broadcast(_bitmap(terms))
    dictionary = stored(index.select("segment", "terms", "counts").mapInArrow(partial(_dictionary, bitmap=bitmap), "term long, segment long, n long"), "dictionary")
    bitmap.destroy()
    frequency = dictionary.groupBy("term").agg(F.sum("n").alias("n"))
    rarest = terms.join(frequency, "term").groupBy("words").agg(F.min(F.struct("n", "term"))["term"].alias("term"), (F.count("*") == F.max("n_terms")).alias("whole"))
    homes = stored(dictionary.select("term", "segment").join(rarest.where("whole").select("words", "term"), "term").select("segment", "words"), "homes")
    parts = homes.groupBy("segment").agg(F.ceil(F.count("*") / DEALT).alias("parts"))
    dealt = homes.join(parts, "segment").groupBy("segment", F.pmod(F.xxhash64("words"), "parts").alias("part")).agg(F.collect_list("words").alias("phrases"))
    found = stored(index.join(dealt.drop("part"), "segment").mapInArrow(partial(_dealt, size=size), "segment long, row long, spans binary, phrases array<binary>"), "found")
    at = ["segment", "row"]
    spans = found.groupBy(*at).agg(F.collect_list("spans").alias("s"))
    items = found.select(*at, F.explode("phrases").alias("words")).join(pairs, "words").groupBy(*at).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    every = index.select("segment", "doc_ids", "first").mapInArrow(_rows, "segment long, row long, doc_id long, n_words long")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    together = every.join(spans, at, "left").join(items, at, "left").select(*at, "doc_id", "n_words", none("s", "binary"), none("items", "string"))
    return stored(together.mapInArrow(_join_blocks, FOUND), "matches")


@lean
def _join_blocks(batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            s = np.frombuffer(b"".join(r.pop("s")), np.int64).reshape(-1, 2)
            r["spans"] = merged(s[:, 0], s[:, 1] - s[:, 0]).tobytes() if len(s) else None
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))]))


@lean
def _verdict(batches):
    yield from _verdicts(batches)


def _verdicts(batches):
    for batch in batches:
        n_words = batch.column("n_words").to_numpy()
        n_hit = np.array([int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2)).sum()) if s else 0 for s in batch.column("spans").to_pylist()], np.int64)
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(n_hit),
                pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i, key=str.encode)).encode()).hexdigest() for i in items], pa.string()),
                pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Of each document: n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of its words or more are hit)."""
    small_batches(docs.sparkSession)
    (pairs, few), segments = _pairs(benchmark, size, "item_id", "text"), index(docs)
    if not few:
        return _dealt_search(segments, pairs, size).mapInArrow(_verdict, RESULT)
    return segments.mapInArrow(partial(_search, shared=_sent(segments, pairs, size), every=True, verdict=True), RESULT)
