"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the 2 to 4 bytes from each byte on, within lower-cased words and their
borders, hashed to BUCKETS embeddings. Mean embedding, then a linear softmax; both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows:
SAMPLE rows, in equal shares for each language, chosen by hash of id and text, equal rows once; at least EACH of
a language, so the sample grows with the languages, of which more than MOST are an error. A fifth of
the sample fits the temperature that calibrates scores, and two bars. A text scoring below the
first, which is never far above a guess's score, is rejected. Scores only tell the languages
from each other, so a second one tells foreign texts: the mean logarithm of the shares that a text's
subwords have in the learned languages together, as deviations from that of a text of its
length. Below all but FEW of the calibration rows it is rejected, unless small letters or each
word once make it usual; texts in two learned languages mostly aren't. Fewer than 20 labelled rows give no second bar. As the model is linear in the mean, embeddings and softmax weights are
multiplied once into one number for each bucket and language.

Only rows with a label whose crc32(doc_id) mod 4 is not 2 are learned from. The label,
source and id of a row are no input of its prediction. Whole texts are read.

Nulls: a null text, and a text without a letter, is `und` with score 0 and rejected; a
null doc_id is not held out and not learned from. Without any labelled row every text is
`und`. Repeated rows each give a result. Other columns stay out of the prediction."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, pack, small_batches, unpack
from .words import LOWER, cuts, utf8

BUCKETS = 1 << 14
DIM = 16
SAMPLE, EACH = 2000, 20  # rows, and of each language at least
MOST = 300  # languages: a row of the sample takes 64 KB
EPOCHS, BATCH, RATE, MOMENTUM, SCALE = 30, 32, 0.1, 0.9, 100.0
NEAR = 1.25  # times the score of a guess: a bar above it would reject texts in two languages too
RARE = 1e-6  # share of a bucket that was never seen
FEW = 0.001  # share of right predictions that rejection may cost on the calibration rows
UNKNOWN = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_LETTER = regex.compile(r"\p{L}")
_B = np.arange(256)
_ASCII_LETTER = ((_B | 32) >= 0x61) & ((_B | 32) <= 0x7A)
#: letters and bytes of other characters stay, everything else is a border
_FOLD = np.where(_ASCII_LETTER | (_B >= 0x80), LOWER, 0x20).astype(np.uint8)


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # languages x (BUCKETS + 1), the last for subwords that don't count
    bias: np.ndarray
    temperature: float
    least: float  # scores below it are rejected
    known: np.ndarray  # logarithm of each bucket's share in the learned languages; 0 for subwords that don't count
    spread: tuple[float, float, float]  # mean of the texts' mean logarithms, and variance of a subword and of a text
    foreign: float  # texts below it are in none of the languages


def subwords(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Bucket of the subword of 2, 3 and 4 bytes from each byte on; BUCKETS where there is none."""
    n = len(data)
    b = np.full(n + 4, 0x20, np.uint8)
    b[:n] = _FOLD[data]
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)  # bytes to the row's end
    blank = b == 0x20
    skip = blank[:n] & blank[1 : n + 1]
    code = b[:n].astype(np.uint32) | (b[1 : n + 1].astype(np.uint32) << np.uint32(8))
    out = []
    for k in range(3):
        if k:
            code = code | (b[1 + k : n + 1 + k].astype(np.uint32) << np.uint32(8 * (1 + k)))
            skip = skip | (blank[k : n + k] & True)  # a border only at either end
        h = code * _ODD[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = (h >> np.uint32(32 - 14)).astype(np.int32)
        at[skip | (left < k + 2)] = BUCKETS
        out.append(at)
    return out


@lean
def _features(batches):
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        blobs = []
        for lo, hi in cuts(offs, 1 << 20):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            at = subwords(d, o)
            for a, b in zip(o[:-1], o[1:], strict=True):
                blobs.append(pack(sum(np.bincount(x[a:b], minlength=BUCKETS + 1) for x in at)[:BUCKETS].astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(blobs, pa.binary())], ["doc_id", "lang", "counts"])


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL AND lang IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2").select("doc_id", "text", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns all languages from about `sample` labelled rows, or EACH of a language where that is more; the same ones each time.
    More than MOST languages are an error."""
    rows = learnable(docs)
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if not count:
        return None
    if len(count) > MOST:
        raise ValueError(f"more than {MOST} languages are labelled; their model would not fit in memory")
    langs = sorted(count)
    sample = max(sample, EACH * len(langs))
    each = max(EACH, sample // len(langs))
    # a share of each language by hash of the id: no sort, no shuffle
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, each / count[k]))]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 20))
    chosen = rows.where(F.col("lang").isin(langs) & (place < share * (1 << 20))).dropDuplicates(["doc_id", "lang", "text"])
    chosen = chosen.orderBy(F.xxhash64("doc_id", "text", F.lit("order")), "doc_id", "lang").limit(2 * sample)
    got = sorted((r.doc_id, r.lang, bytes(r.counts)) for r in chosen.mapInArrow(_features, "doc_id long, lang string, counts binary").collect())
    x, used = np.zeros((len(got), BUCKETS), np.float32), np.zeros(len(got), np.int64)
    for k, (_, _, blob) in enumerate(got):
        c = unpack(blob, np.uint32)
        used[k] = c.sum()
        x[k] = c / max(1, used[k])
    return train(x, np.array([langs.index(g[1]) for g in got], np.int64), langs, used)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], used: np.ndarray) -> Model:
    """Stochastic gradient descent with momentum on cross-entropy; a fifth of the rows only calibrates."""
    rng = np.random.default_rng(9)
    order = rng.permutation(len(x))
    keep, back = (order[len(x) // 5 :], order[: len(x) // 5]) if len(x) >= 20 else (order, order)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    speed = [np.zeros_like(p) for p in (emb, out, bias)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(keep)
        for at in range(0, len(keep), BATCH):
            some = keep[at : at + BATCH]
            xs = x[some] * SCALE
            mean = xs @ emb
            p = softmax(mean @ out + bias)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            grads = (xs.T @ (p @ out.T), mean.T @ p, p.sum(0))
            for v, g, w in zip(speed, grads, (emb, out, bias), strict=True):
                v *= MOMENTUM
                v -= rate * g
                w += v
    table = np.zeros((len(langs), BUCKETS + 1), np.float32)
    table[:, :BUCKETS] = SCALE * (emb @ out).T
    logits = x[back] @ table[:, :BUCKETS].T + bias
    rows = np.arange(len(back))
    steps = np.exp(np.linspace(-2, 3, 51))
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, y[back]], 1e-12)).mean() for t in steps]
    temperature = float(steps[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.argmax(1) == y[back]
    least = min(0.5, NEAR / len(langs), float(np.quantile(p.max(1)[right], FEW))) if right.any() else 0.0
    # how usual a text's subwords are in any of the languages, each with the same weight
    shares = np.mean([x[keep[y[keep] == k]].mean(0, dtype=np.float64) for k in np.unique(y[keep])], 0)
    known = np.append(np.log(shares + RARE), 0.0)
    usual = x[back] @ known[:BUCKETS]
    centre = float(np.median(usual))
    some = np.maximum(used[back], 1)
    # variance falls with the number of subwords to that between long texts
    slope, flat = np.linalg.lstsq(np.stack([1 / some, np.ones(len(some))], 1), (usual - centre) ** 2, rcond=None)[0]
    spread = (centre, max(float(slope), 1e-3), max(float(flat), 1e-3))
    # few calibration rows have no such quantile: not above that of a normal distribution, and none without rows of their own
    foreign = min(-3.1, float(np.quantile(usualness(usual, some, spread), FEW))) if len(x) >= 20 else -np.inf
    return Model(langs, table, bias, temperature, least, known, spread, foreign)


def usualness(mean: np.ndarray, used: np.ndarray, spread: tuple[float, float, float]) -> np.ndarray:
    centre, slope, flat = spread
    return (mean - centre) / np.sqrt(slope / np.maximum(used, 1) + flat)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _stays_foreign(text: str, model: Model) -> bool:
    """Whether a text is as unusual in small letters, which bytes have for A to Z only, and with each word once."""
    low = text.lower()
    for t in (low, " ".join(dict.fromkeys(low.split()))):
        data = np.frombuffer(t.encode(), np.uint8)
        at = subwords(data, np.array([0, len(data)]))
        used = sum(int((a < BUCKETS).sum()) for a in at)
        mean = sum(float(model.known[a].sum()) for a in at) / max(1, used)
        if not used or usualness(mean, used, model.spread) >= model.foreign:
            return False
    return True


@lean
def predict(texts: pa.Array, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    data, offs = utf8(texts)
    n = len(offs) - 1
    if model is None:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    lang, score, foreign = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
    for lo, hi in cuts(offs, 1 << 20):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        full = np.flatnonzero(np.diff(o))
        if not len(full):
            continue
        begin = o[:-1][full]
        letters = np.logical_or.reduceat(_ASCII_LETTER[d], begin)
        for k in np.flatnonzero(~letters):
            r = full[k]
            letters[k] = bool(_LETTER.search(d[o[r] : o[r + 1]].tobytes().decode("utf-8", "replace")))
        at = subwords(d, o)
        used = sum(np.add.reduceat((a < BUCKETS).astype(np.int32), begin) for a in at)
        z = np.empty((len(full), len(model.langs) + 1))
        for k, column in enumerate((*model.table, model.known)):
            v = column[at[0]]
            v += column[at[1]]
            v += column[at[2]]
            z[:, k] = np.add.reduceat(v, begin, dtype=np.float64)
        z /= np.maximum(used, 1)[:, None]
        p = softmax((z[:, :-1] + model.bias) / model.temperature)
        rows = lo + full
        lang[rows] = np.where(letters, p.argmax(1), -1)
        score[rows] = np.where(letters, p.max(1), 0)
        odd = (used > 0) & (usualness(z[:, -1], used, model.spread) < model.foreign)
        for k in np.flatnonzero(odd):
            odd[k] = _stays_foreign(d[o[full[k]] : o[full[k] + 1]].tobytes().decode("utf-8", "replace"), model)
        foreign[rows] = odd
    return [UNKNOWN if k < 0 else model.langs[k] for k in lang], score, (lang < 0) | (score < model.least) | foreign


def identified(model, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def apply(texts: pa.Array) -> pa.Array:
        lang, score, rejected = predict(texts, model.value)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return apply(text)


def identify(docs: DataFrame, sample: int = SAMPLE, into: str = "language") -> DataFrame:
    """docs with a column `into`, struct(lang_pred, score, rejected), learned from its own labels.
    A docs that has such a column keeps it, and the new one gets underscores."""
    small_batches(docs.sparkSession)
    taken = {c.lower() for c in docs.columns}
    while into.lower() in taken:
        into += "_"
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    return docs.withColumn(into, identified(model, F.col("text")))


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose text is not rejected, with their own columns."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    return docs.where(~identified(model, F.col("text"))["rejected"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
