"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

Statistics of whole texts are counted in numpy. Trees are fitted to `labels` in numpy on
histograms: least squares on the gradients of the logistic loss, with monotonic
constraints on chosen statistics (more symbols, repeats or capitals never raise the
verdict). They are flattened to arrays of nodes, and all rows descend together.

The fit takes all labelled rows that pass the base rules. They are dealt to barrier tasks of some
PER_TASK rows, as many as the cluster runs at once at most; for each level of a tree tasks send each other
the histograms of their rows, of fixed size, and find the same splits. A fifth of the rows, by hash, sets the bar, below which at
most FEW of the good ones fall. Statistics are of all documents. The fitted trees are some thousand numbers, sent to all tasks.

Nulls: a null text has no words and fails the base rules; a null doc_id has no label; null
labels are not learned from. Without labels, or with one class, only the base rules
judge. Repeated rows each give a result; repeated labels each count. Texts of any
length are read whole. An empty table gives an empty result.
Ids are cast to long: an id that is no number is an error under ANSI.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import first_of_runs, lean, small_batches, stored
from .words import NOT_SPACE, WordHash, cuts, scan, utf8, window_hash, window_starts

PER_TASK = 250_000
#: Values of a statistic that a task sends, at even ranks, to place the bins' edges
POINTS = 4096
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 4, 0.15, 64, 20, 1.0
FEW = 0.005
WINDOW = 5
_HASH = WordHash(8)
_B = np.arange(256)
#: The characters that the contract counts as symbols
_SYMBOL = np.isin(_B, np.frombuffer(b"#*$%&|<>", np.uint8))
_LINE = _B != 0x0A
_UPPER, _DIGIT = (_B >= 0x41) & (_B <= 0x5A), (_B >= 0x30) & (_B <= 0x39)
_LETTER = ((_B | 32) >= 0x61) & ((_B | 32) <= 0x7A)
_PUNCT = (_B < 0x80) & (_B > 0x20) & ~_LETTER & ~_DIGIT

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_punct", "n_marked", "n_letters"]
#: Statistics the trees see, with their constraint: -1 falls, 0 free
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "line_words": 0, "distinct": 0, "upper": -1, "digits": 0, "punct": 0, "marked": -1}


def _count(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def _per_row(mark: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[offs[1:]] - total[offs[:-1]]


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row."""
    n = len(offs) - 1
    starts, ends, first = scan(data, offs, NOT_SPACE)
    h = _HASH(data, starts, ends)
    rows = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first)}
    whole = (data & 0xC0) != 0x80  # the first byte of each code point
    word = NOT_SPACE[data]
    out["word_chars"] = _per_row(whole & word, offs)
    for name, kind in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT), ("n_letters", _LETTER)):
        out[name] = _per_row(kind[data], offs)
    out["n_marked"] = _count(rows[_PUNCT[data[ends - 1]] & _PUNCT[data[np.maximum(ends - 2, 0)]] & (ends - starts > 2)], n) if len(ends) else np.zeros(n, np.int64)
    order = np.lexsort((h, rows))
    out["n_distinct"] = _count(rows[order][first_of_runs(rows[order], h[order])], n)
    # lines with a word, and those equal to an earlier one
    a, b, line_first = scan(data, offs, _LINE)
    line_row = np.repeat(np.arange(n), np.diff(line_first))
    words = np.concatenate([[0], np.cumsum(word)])
    some = words[b] > words[a]
    a, b, line_row = a[some], b[some], line_row[some]
    lh = _HASH(data, a, b)
    order = np.lexsort((lh, line_row))
    out["n_lines"] = _count(line_row, n)
    out["n_dup_lines"] = out["n_lines"] - _count(line_row[order][first_of_runs(line_row[order], lh[order])], n)
    # words in windows that stand twice in the text
    at = window_starts(first, WINDOW)
    x = window_hash(h, at, WINDOW)
    row = rows[at]
    order = np.lexsort((x, row))
    run = first_of_runs(row[order], x[order])
    size = np.diff(np.append(run, len(x)))
    twice = at[order][np.repeat(size > 1, size)]
    cover = np.zeros(len(h) + 1, np.int32)
    cover[:-1] += np.bincount(twice, minlength=len(h))[: len(h)].astype(np.int32)
    cover -= np.bincount(twice + WINDOW, minlength=len(h) + 1)[: len(h) + 1].astype(np.int32)
    out["n_repeat_words"] = _count(rows[np.cumsum(cover[:-1]) > 0], n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: np.asarray(v, np.float64) for k, v in c.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / chars,
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_words"] / np.maximum(c["n_lines"], 1),
            c["n_distinct"] / words,
            c["n_upper"] / np.maximum(c["n_letters"], 1),
            c["n_digits"] / chars,
            c["n_punct"] / chars,
            c["n_marked"] / words,
        ],
        1,
    )


class Trees:
    """Flattened trees: node k of all trees tests x[feature[k]] < cut[k]; leaves have feature -1."""

    def __init__(self, feature, cut, left, right, value, roots, base):
        self.feature, self.cut, self.left, self.right, self.value, self.roots, self.base = feature, cut, left, right, value, roots, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all rows and trees go down one level at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] < self.cut[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out


Gather = Callable[[np.ndarray], list[np.ndarray]]


def _alone(a: np.ndarray) -> list[np.ndarray]:
    return [a]


def _edges(x: np.ndarray, gather: Gather) -> list[np.ndarray]:
    """Between bins of each statistic: values at even ranks of all tasks' rows. A task of up to POINTS rows sends all of them."""
    n, width = x.shape
    at = np.linspace(0, max(0, n - 1), min(n, POINTS)).round().astype(np.int64)
    parts = gather(np.concatenate([[n], np.sort(x, 0)[at].ravel()]))
    values = np.concatenate([p[1:].reshape(-1, width) for p in parts])
    weight = np.concatenate([np.full(m := (len(p) - 1) // width, p[0] / max(1, m)) for p in parts])
    out = []
    for f in range(width):
        order = np.argsort(values[:, f], kind="stable")
        upto = np.cumsum(weight[order])
        out.append(np.unique(values[order, f][np.searchsorted(upto, np.linspace(0, 1, BINS + 1)[1:-1] * upto[-1]).clip(max=len(upto) - 1)]))
    return out


def _split(hist: np.ndarray, cuts: np.ndarray, signs: np.ndarray, own: float, low: float, high: float):
    """Statistic, cut, values and sums on both sides of the best split of a node, or None. hist: gradient, curvature and rows by statistic and bin."""
    g, h, n = hist[:, 0].sum(1)
    gl, hl, nl = np.cumsum(hist, 2)[:, :, :-1]
    vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip((g - gl) / (h - hl + RIDGE), low, high)
    gain = vl * (gl - 0.5 * (hl + RIDGE) * vl) + vr * ((g - gl) - 0.5 * (h - hl + RIDGE) * vr) - own * (g - 0.5 * (h + RIDGE) * own)
    ok = cuts & (nl >= LEAST) & (n - nl >= LEAST) & (signs[:, None] * (vr - vl) >= 0)
    gain = np.where(ok, gain, -np.inf)
    f, j = np.unravel_index(np.argmax(gain), gain.shape)
    if gain[f, j] <= 1e-6:
        return None
    return int(f), int(j), float(vl[f, j]), float(vr[f, j]), int(nl[f, j]), int(n - nl[f, j])


def boost(x: np.ndarray, y: np.ndarray, signs: list[int], gather: Gather = _alone, n_trees: int = TREES) -> Trees:
    """Gradient boosting on binned statistics; a split against its statistic's sign is not taken, and
    children stay on their side of the middle of both values, so that the whole tree is monotonic.

    x and y are the rows of one task; gather gives the arrays that all tasks passed to it, in one order. All tasks get the same trees."""
    width, signs = x.shape[1], np.array(signs)

    def total(a) -> np.ndarray:  # in the order of tasks, so that all have the same sums
        a = np.asarray(a, np.float64)
        return np.sum(gather(a.ravel()), axis=0).reshape(a.shape)

    edges = _edges(x, gather)
    binned = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], 1).astype(np.uint8)
    cuts = np.arange(BINS - 1)[None] < np.array([len(e) for e in edges])[:, None]
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    good, n = total([y.sum(), len(y)])
    p = np.clip(good / n, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    score = np.full(len(y), base)

    def node() -> int:
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        roots.append(node())
        at = np.full(len(y), roots[-1])  # the node of each row
        level = [(roots[-1], int(n), None, -np.inf, np.inf)]
        for depth in range(DEPTH):
            todo = [t for t in level if t[1] >= 2 * LEAST or t[2] is None]
            if not todo:
                break
            place = np.full(len(feature), -1)
            place[[t[0] for t in todo]] = np.arange(len(todo))
            rows = np.flatnonzero(place[at] >= 0)
            start, size = place[at[rows]] * BINS, len(todo) * BINS
            hist, g, h = np.empty((3, width, size)), grad[rows], hess[rows]
            for f in range(width):
                bins = start + binned[rows, f]
                hist[:, f] = np.bincount(bins, g, size), np.bincount(bins, h, size), np.bincount(bins, minlength=size)
            hist = total(hist).reshape(3, width, len(todo), BINS)
            level = []
            for j, (k, _, own, low, high) in enumerate(todo):
                if own is None:  # the root
                    own = float(hist[0, 0, j].sum() / (hist[1, 0, j].sum() + RIDGE))
                    value[k] = own * RATE
                best = _split(hist[:, :, j], cuts, signs, own, low, high)
                if best is None:
                    continue
                f, b, vl, vr, nl, nr = best
                feature[k], cut[k] = f, float(edges[f][b])
                left[k], right[k] = node(), node()
                value[left[k]], value[right[k]] = vl * RATE, vr * RATE
                mid = (vl + vr) / 2
                lows, highs = ((low, mid), (mid, high)) if signs[f] > 0 else ((mid, high), (low, mid)) if signs[f] < 0 else ((low, high), (low, high))
                level += [(left[k], nl, vl, *lows), (right[k], nr, vr, *highs)]
                mine = rows[at[rows] == k]
                at[mine] = np.where(binned[mine, f] <= b, left[k], right[k])
        score += np.array(value)[at]
    return Trees(*(np.array(a) for a in (feature, cut, left, right, value, roots)), base)


@lean
def _measure(batches):
    for batch in batches:
        data, offs = utf8(batch.column("text"))
        for lo, hi in cuts(offs, 1 << 20):
            s = statistics(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(s[k]) for k in COUNTS]], ["doc_id", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of each document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def _learn(x: np.ndarray, y: np.ndarray, back: np.ndarray, gather: Gather, n_trees: int) -> tuple[Trees, float, int]:
    """Trees, the bar in log odds and the number of rows they come from, from all tasks' rows; rows held `back` set the bar."""
    count = lambda of: np.sum(gather(np.array([of.sum(), (of & (y > 0)).sum()], np.float64)), axis=0)
    (kept, kept_good), (held, held_good) = count(~back), count(back)
    apart = held_good and kept_good not in (0, kept)
    if not apart:
        back = np.zeros(len(y), bool)
    trees = boost(x[~back], y[~back], list(FEATURES.values()), gather, n_trees)
    judge = back if apart else ~back
    good = np.sort(trees.score(x[judge & (y > 0)]))
    n = int(np.sum(gather(np.array([len(good)], np.float64))))
    low = np.sort(np.concatenate(gather(good[: int(FEW * n) + 1])))  # the lowest of all tasks
    return trees, float(min(0.0, low[int(FEW * n)])), int(kept + held)


def _together(a: np.ndarray) -> list[np.ndarray]:
    """What all tasks of the barrier stage passed, in the order of partitions."""
    sent = BarrierTaskContext.get().allGather(base64.b64encode(np.asarray(a, np.float64).tobytes()).decode())
    return [np.frombuffer(base64.b64decode(m)) for m in sent]


def _fitted(batches, gather: Gather, n_trees: int):
    """One row, from the first task: what all of them learned."""
    table = pa.Table.from_batches(list(batches))
    x = features({k: table.column(k).to_numpy() for k in COUNTS})
    learned = _learn(x, (table.column("quality").to_numpy() > 0).astype(np.float64), table.column("back").to_numpy(), gather, n_trees)
    if TaskContext.get().partitionId() == 0:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned)], pa.binary())], ["model"])


def fit(measured: DataFrame, labels: DataFrame, per_task: int = PER_TASK, n_trees: int = TREES) -> tuple[Trees, float, int] | None:
    """Trees, the bar in log odds and the number of rows learned from: all labelled rows that pass the base rules; repeated rows count once.

    Several tasks exchange a level's histograms in about a second, whatever their rows, so that 80 trees take some six minutes."""
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    rows = stored(measured.join(labels, "doc_id").where(~base_failed()).select("doc_id", "quality", *COUNTS).distinct(), "labelled")
    n, good = rows.agg(F.count("*"), F.count_if(F.col("quality") > 0)).first()
    if not n or good in (0, n):
        return None
    tasks = max(1, min(-(-n // per_task), rows.sparkSession.sparkContext.defaultParallelism))
    dealt = rows.withColumn("back", F.pmod(F.xxhash64("doc_id", "quality", F.lit("back")), F.lit(5)) == 0).repartition(tasks, *rows.columns)
    dealt = dealt.sortWithinPartitions(*rows.columns)  # so that sums are the same in each run
    gather = _alone if tasks == 1 else _together
    return pickle.loads(dealt.mapInArrow(partial(_fitted, gather=gather, n_trees=n_trees), "model binary", barrier=tasks > 1).collect()[0].model)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each document: COUNTS, base_failed, score (probability of good quality) and kept."""
    small_batches(docs.sparkSession)
    measured = stored(measure(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(measured, labels))

    @F.arrow_udf("double")
    def log_odds(*counts: pa.Array) -> pa.Array:
        if model.value is None:
            return pa.array(np.zeros(len(counts[0])))
        x = features({k: c.to_numpy(zero_copy_only=False) for k, c in zip(COUNTS, counts, strict=True)})
        return pa.array(model.value[0].score(x))

    bar = model.value[1] if model.value else 0.0
    out = measured.withColumn("odds", log_odds(*[F.col(k) for k in COUNTS])).withColumn("base_failed", base_failed())
    return out.withColumn("score", 1 / (1 + F.exp(-F.col("odds")))).withColumn("kept", ~F.col("base_failed") & (F.col("odds") >= F.lit(bar))).drop("odds")
