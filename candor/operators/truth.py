"""The latent truth model over (owner, question, factor) observations.

An answer is one row: packed() has a bit for each factor, in numbers of WORD bits, and a question's truth is such a bit set
too. observations() gives the dense grid, where that is asked for. synchronous sweeps draw all factors from the same counts;
an owner's counts are kept, and a sweep adds what its flipped factors change. gibbs() is the sequential chain, whose counts every draw changes,
so that it runs as one group; it refuses more than MOST_CELLS observations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor import checkpoints
from candor.config import Config
from candor.functions.rng import uniform


MOST_CELLS = 20_000_000
WORD = 62  # bits of a number in a bit set


def _parts(factors: int) -> list[tuple[int, int]]:
    """The first factor of each number of a bit set, and how many it holds."""
    return [(a, min(WORD, factors - a)) for a in range(0, factors, WORD)]


def _bit(bits: str, factor: int) -> Column:
    """Whether a factor's bit is set in the column of bit sets."""
    return F.shiftright(F.get(bits, F.lit(factor // WORD)), factor % WORD).bitwiseAND(F.lit(1)) == 1


def _shift(by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), by.cast("int"))


def packed(answers: DataFrame, words: DataFrame, factors: int) -> DataFrame:
    """question_id, owner_id, obs: an answer's observations as a bit set, by one aggregation of its words' clusters."""
    bits = [F.bit_or(F.when(F.col("cluster").between(a, a + n - 1), _shift(F.col("cluster") - a))).alias(f"b{k}") for k, (a, n) in enumerate(_parts(factors))]
    seen = words.groupBy("question_id", "owner_id").agg(*bits)
    every = answers.select("question_id", "owner_id").distinct().join(seen, ["question_id", "owner_id"], "left")
    return every.select("question_id", "owner_id", F.array(*[F.coalesce(f"b{k}", F.lit(0).cast("long")) for k in range(len(bits))]).alias("obs"))


def repacked(observations: DataFrame, factors: int) -> DataFrame:
    """The packed form of a dense grid."""
    seen = observations.where("obs = 1").withColumn("cluster", F.col("factor"))
    return packed(observations, seen, factors)


def unpacked(packed: DataFrame, factors: int, bits: str = "obs", name: str = "obs") -> DataFrame:
    """A row for each factor of each bit set."""
    number = F.element_at(bits, F.floor(F.col("factor") / WORD).cast("int") + 1)
    rows = packed.withColumn("factor", F.explode(F.sequence(F.lit(0), F.lit(factors - 1))))
    value = F.call_function("shiftright", number, F.col("factor") % WORD).bitwiseAND(F.lit(1)).cast("int")
    keys = [c for c in packed.columns if c != bits]
    return rows.select(*keys, "factor", value.alias(name))


def observations(answers: DataFrame, words: DataFrame, factors: int) -> DataFrame:
    """question_id, owner_id, factor, obs: 1 where the owner's answer has a word of the cluster, for every factor."""
    return unpacked(packed(answers, words, factors), factors)


def initial_truth(observations: DataFrame, seed: str = "truth") -> DataFrame:
    """question_id, factor, indicator: a coin for each factor."""
    factors = observations.select("question_id", "factor").distinct()
    return factors.withColumn("indicator", F.when(uniform(f"{seed}:init", "question_id", "factor") < 0.5, 0).otherwise(1))


def prior_counts(observations: DataFrame, truth: DataFrame) -> DataFrame:
    """owner_id, n00, n01, n10, n11: by indicator and observation over all questions."""
    both = observations.join(truth, ["question_id", "factor"])
    cell = lambda i, o: F.count_if((F.col("indicator") == i) & (F.col("obs") == o)).alias(f"n{i}{o}")
    return both.groupBy("owner_id").agg(*[cell(i, o) for i in (0, 1) for o in (0, 1)])


def log_likelihood(observations: DataFrame, truth: DataFrame, counts: DataFrame, config: Config = Config()) -> DataFrame:
    """question_id, factor, indicator, l0, l1; the count of the present indicator is less by one in the numerator only."""
    rows = observations.join(truth, ["question_id", "factor"]).join(counts, "owner_id")
    a = config.alpha

    def term(i: int) -> Column:
        own = F.when(F.col("obs") == 1, F.col(f"n{i}1") + F.lit(a[2 * i + 1])).otherwise(F.col(f"n{i}0") + F.lit(a[2 * i]))
        less = F.when(F.col("indicator") == i, 1.0).otherwise(0.0)
        return F.ln((own - less) / (F.lit(a[2 * i] + a[2 * i + 1]) + F.col(f"n{i}0") + F.col(f"n{i}1")))

    sums = rows.groupBy("question_id", "factor", "indicator").agg(F.sum(term(0)).alias("s0"), F.sum(term(1)).alias("s1"))
    return sums.select("question_id", "factor", "indicator", (F.col("s0") + F.ln(F.lit(config.beta[0]))).alias("l0"), (F.col("s1") + F.ln(F.lit(config.beta[1]))).alias("l1"))


def most_likely(likelihood: DataFrame) -> DataFrame:
    return likelihood.select("question_id", "factor", F.when(F.col("l0") > F.col("l1"), 0).otherwise(1).alias("indicator"))


def drawn(likelihood: DataFrame, seed: str, sweep: int) -> DataFrame:
    """An indicator for each factor by its probability, after a shift by the larger logarithm."""
    top = F.greatest("l0", "l1")
    e0, e1 = F.exp(F.col("l0") - top), F.exp(F.col("l1") - top)
    u = uniform(f"{seed}:sweep", F.lit(sweep), F.col("question_id"), F.col("factor"))
    return likelihood.select("question_id", "factor", F.when(u < e0 / (e0 + e1), 0).otherwise(1).alias("indicator"))


def _set_of(factors: int, chosen) -> Column:
    """A bit set of the factors that `chosen`, from a column to a condition, takes."""
    number = lambda a, n: F.aggregate(F.sequence(F.lit(a), F.lit(a + n - 1)), F.lit(0).cast("long"), lambda s, f: s.bitwiseOR(F.when(chosen(f), _shift(f - a)).otherwise(F.lit(0).cast("long"))))
    return F.array(*[number(a, n) for a, n in _parts(factors)])


def _ones(of: Column, factors: int) -> Column:
    """The bits set in an array of numbers."""
    return sum((F.bit_count(F.get(of, F.lit(k))) for k in range(len(_parts(factors)))), F.lit(0))


def _both(a: str, b: str, flip_b: bool = False) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y) if flip_b else y))


def packed_counts(answers: DataFrame, truth: DataFrame, factors: int) -> DataFrame:
    """As prior_counts(), of packed observations and truth (question_id, z)."""
    rows = answers.join(truth.select("question_id", "z"), "question_id")
    n11, one, seen = _ones(_both("z", "obs"), factors), _ones(F.col("z"), factors), _ones(F.col("obs"), factors)
    cells = {"n11": n11, "n10": one - n11, "n01": seen - n11, "n00": factors - one - seen + n11}
    return rows.groupBy("owner_id").agg(*[F.sum(c).cast("long").alias(n) for n, c in cells.items()])


def changed_counts(counts: DataFrame, answers: DataFrame, truth: DataFrame, factors: int) -> DataFrame:
    """counts after the flips of a sweep: only answers to questions with a flipped factor are read. truth: question_id, was, z."""
    flipped = truth.where("was <> z").select("question_id", _both("z", "was", True).alias("up"), _both("was", "z", True).alias("down"))
    rows = answers.join(flipped, "question_id")
    seen = _ones(_both("up", "obs"), factors) - _ones(_both("down", "obs"), factors)
    unseen = _ones(_both("up", "obs", True), factors) - _ones(_both("down", "obs", True), factors)
    delta = rows.groupBy("owner_id").agg(F.sum(seen).alias("d1"), F.sum(unseen).alias("d0"))
    d1, d0 = F.coalesce("d1", F.lit(0)), F.coalesce("d0", F.lit(0))
    moved = {"n11": F.col("n11") + d1, "n10": F.col("n10") + d0, "n01": F.col("n01") - d1, "n00": F.col("n00") - d0}
    return counts.join(delta, "owner_id", "left").select("owner_id", *[c.alias(n) for n, c in moved.items()])


class Terms:
    """The columns of packed_likelihood(), which all sweeps share: a question's factors make many, so they are built once."""

    def __init__(self, factors: int, config: Config = Config()):
        a = config.alpha

        def log(i: int, o: int, less: int) -> Column:
            own = F.col(f"n{i}{o}") + F.lit(a[2 * i + o]) - less
            # where a cell itself counts, own is above 0; other answers don't need the smaller logarithm
            return F.coalesce(F.when(own > 0, F.ln(own / (F.lit(a[2 * i] + a[2 * i + 1]) + F.col(f"n{i}0") + F.col(f"n{i}1")))), F.lit(0.0))

        seen, true = [_bit("obs", f) for f in range(factors)], [_bit("z", f) for f in range(factors)]
        by = {(i, less): F.col(f"t{i}1{less}") - F.col(f"t{i}0{less}") for i in (0, 1) for less in (0, 1)}
        differs = lambda f, i: F.sum(F.when(seen[f], F.when(true[f], by[i, i]).otherwise(by[i, 1 - i])).otherwise(0.0)).alias(f"s{i}_{f}")
        self.logs = [log(i, o, less).alias(f"t{i}{o}{less}") for i in (0, 1) for o in (0, 1) for less in (0, 1)]
        self.sums = [F.sum(f"t{i}0{less}").alias(f"base{i}{less}") for i in (0, 1) for less in (0, 1)]
        self.sums += [differs(f, i) for i in (0, 1) for f in range(factors)]
        whole = lambda i: F.array(*[F.col(f"s{i}_{f}") + F.when(true[f], F.col(f"base{i}{i}")).otherwise(F.col(f"base{i}{1 - i}")) + F.ln(F.lit(config.beta[i])) for f in range(factors)])
        self.whole = [whole(0).alias("l0"), whole(1).alias("l1")]


def packed_likelihood(answers: DataFrame, truth: DataFrame, counts: DataFrame, terms: Terms) -> DataFrame:
    """question_id, z, l0, l1 (arrays by factor): as log_likelihood(), from one row for each answer.

    A factor's sum is that of all answers as if none had seen it, and what it differs by for those that have."""
    rows = answers.join(truth.select("question_id", "z"), "question_id").join(counts, "owner_id")
    sums = rows.select("question_id", "z", "obs", *terms.logs).groupBy("question_id", "z").agg(*terms.sums)
    return sums.select("question_id", "z", *terms.whole)


def swept(likelihood: DataFrame, factors: int, draw: bool, seed: str, sweep: int) -> DataFrame:
    """question_id, was, z: the next truth of each question, drawn or most likely."""

    def one(f: Column) -> Column:
        l0, l1 = F.get("l0", f), F.get("l1", f)
        if not draw:
            return ~(l0 > l1)
        top = F.greatest(l0, l1)
        e0, e1 = F.exp(l0 - top), F.exp(l1 - top)
        return ~(uniform(f"{seed}:sweep", F.lit(sweep), F.col("question_id"), f) < e0 / (e0 + e1))

    return likelihood.select("question_id", F.col("z").alias("was"), _set_of(factors, one).alias("z"))


def synchronous(observations: DataFrame, sweeps: int, config: Config = Config(), draw: bool = False, factors: int | None = None) -> DataFrame:
    """question_id, factor, indicator after sweeps of all factors at once.

    observations: packed, with the number of factors, or a dense grid. The answers are written once; each sweep writes the truth of
    each question and the counts of each owner, and deletes those of the sweep before. Most likely truths end the loop when they stand
    still, or when they are those of two sweeps before: from there on two truths alternate."""
    if "factor" in observations.columns:
        factors = factors or (observations.agg(F.max("factor")).first()[0] or 0) + 1
        observations = repacked(observations, factors)
    answers = checkpoints.cut(observations)
    loop = checkpoints.Loop(answers.sparkSession)
    coin = lambda f: ~(uniform(f"{config.seed}:init", F.col("question_id"), f) < 0.5)
    truth = loop.cut(answers.select("question_id").distinct().withColumn("z", _set_of(factors, coin)))
    counts = loop.cut(packed_counts(answers, truth, factors)) if sweeps else None
    terms = Terms(factors, config) if sweeps else None
    for k in range(sweeps):
        before = truth
        truth = loop.cut(swept(packed_likelihood(answers, truth, counts, terms), factors, draw, config.seed, k))
        if not draw and k + 1 < sweeps:
            both = truth.join(before.select("question_id", F.col("was" if k else "z").alias("twice")), "question_id")
            seen = both.agg(F.count_if(F.col("was") != F.col("z")).alias("flips"), F.count_if(F.col("z") != F.col("twice")).alias("new")).first()
            if not seen.flips:
                break
            if k and not seen.new:
                truth = truth.select("question_id", F.col("was" if (sweeps - k - 1) % 2 else "z").alias("z"))
                break
        if k + 1 < sweeps:
            counts = loop.cut(changed_counts(counts, answers, truth, factors))
        loop.turn()
    loop.close()
    return unpacked(truth.select("question_id", "z"), factors, "z", "indicator")


def gibbs(observations: DataFrame, config: Config = Config(), most: int = MOST_CELLS) -> DataFrame:
    """question_id, factor, indicator: the last sample of the sequential chain, in one group of at most `most` cells."""
    cells = observations.count()
    if cells > most:
        raise ValueError(f"{cells} observations are too many for one chain (at most {most}); use synchronous(draw=True)")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        cells = rows.sort_values(["question_id", "factor", "owner_id"], ignore_index=True)
        owners, owner = np.unique(cells["owner_id"].to_numpy(), return_inverse=True)
        obs = cells["obs"].to_numpy()
        key = cells[["question_id", "factor"]].to_numpy()
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        end = np.r_[start[1:], len(cells)]
        rng = np.random.default_rng(list(config.seed.encode()))
        z = rng.integers(0, 2, len(start))
        n = np.zeros((len(owners), 2, 2))
        for f, (a, b) in enumerate(zip(start, end, strict=True)):
            np.add.at(n, (owner[a:b], z[f], obs[a:b]), 1)
        alpha = np.array(config.alpha).reshape(2, 2)
        n, alpha = n.reshape(-1).tolist(), alpha.reshape(-1).tolist()  # small groups are faster as numbers than as arrays
        who, saw, now = (owner * 4).tolist(), obs.tolist(), z.tolist()
        spans, prior = list(zip(start.tolist(), end.tolist(), strict=True)), config.beta
        a0, a1 = alpha[0] + alpha[1], alpha[2] + alpha[3]
        for _ in range(config.sweeps):
            draws = rng.random(len(spans)).tolist()
            for f, (a, b) in enumerate(spans):
                own = now[f]
                less0, less1 = 1 - own, own
                log, ratio = math.log(prior[1] / prior[0]), 1.0
                for c in range(a, b):
                    o, x = who[c], saw[c]
                    ratio *= (n[o + 2 + x] + alpha[2 + x] - less1) * (a0 + n[o] + n[o + 1]) / ((a1 + n[o + 2] + n[o + 3]) * (n[o + x] + alpha[x] - less0))
                    if not 1e-100 < ratio < 1e100:
                        log, ratio = log + math.log(ratio), 1.0
                log += math.log(ratio)  # of true to false
                new = 0 if draws[f] < (1 / (1 + math.exp(log)) if log < 700 else 0.0) else 1
                if new != own:
                    for c in range(a, b):
                        at = who[c] + saw[c]
                        n[at + 2 * own] -= 1
                        n[at + 2 * new] += 1
                    now[f] = new
        z = np.array(now)
        out = pd.DataFrame(key[start], columns=["question_id", "factor"])
        return out.assign(indicator=z)

    kind = dict(observations.dtypes)["question_id"]
    return observations.groupBy().applyInPandas(run, f"question_id {kind}, factor int, indicator int")
