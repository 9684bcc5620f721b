"""Keywords of answers, and what hides their frequencies: padding, dummy words, shuffling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.config import Config
from candor.functions.rng import hash32, uniform
from candor.functions.text import pad, tokens, unpad
from candor.operators.order import places

#: Rows of a question that one task sorts; beyond, places are found by ranges
FITS = 250_000


def tokenized(answers: DataFrame) -> DataFrame:
    """question_id, owner_id, pos, content: every word of every answer."""
    return answers.select("question_id", "owner_id", F.posexplode(tokens(F.col("raw_answer"))).alias("pos", "content"))


def keywords(answers: DataFrame, stopwords: DataFrame | None = None, word_model: DataFrame | None = None) -> DataFrame:
    """Words that are no stopwords and in the model, where these are given."""
    return filtered(tokenized(answers), stopwords, word_model)


def filtered(words: DataFrame, stopwords: DataFrame | None, word_model: DataFrame | None) -> DataFrame:
    if stopwords is not None:
        words = words.join(stopwords.select(F.col("word").alias("content")), "content", "left_anti")
    if word_model is not None:
        words = words.join(word_model.select(F.col("word").alias("content")), "content", "left_semi")
    return words.select("question_id", "owner_id", "pos", "content")


def with_vectors(words: DataFrame, word_model: DataFrame) -> DataFrame:
    return words.join(word_model.withColumnRenamed("word", "content"), "content")


def distinct_words(words: DataFrame) -> DataFrame:
    """question_id, content, n: clustering needs each word of a question once, with its count."""
    return words.groupBy("question_id", "content").agg(F.count("*").alias("n"))


def weighed_words(words: DataFrame) -> DataFrame:
    """As distinct_words(), but dummies count nothing: a word that only dummies have is there with n = 0."""
    return words.groupBy("question_id", "content").agg(F.count_if(F.col("owner_id") != -1).alias("n"))


def vocabulary(words: DataFrame) -> DataFrame:
    """Distinct words of each question; equal ones are combined before the shuffle, so that a frequent word is one row."""
    return words.select("question_id", "content").distinct()


def padded(words: DataFrame) -> DataFrame:
    """content filled with spaces to the question's longest word, rounded up to 4."""
    width = words.groupBy("question_id").agg((F.ceil(F.max(F.char_length("content")) / 4) * 4).cast("int").alias("width"))
    return words.join(width, "question_id").withColumn("content", pad(F.col("content"), F.col("width")))


def unpadded(words: DataFrame) -> DataFrame:
    return words.withColumn("content", unpad(F.col("content"))).drop("width")


def gamma_alpha(n_words: Column, config: Config = Config()) -> Column:
    """Half the most dummies of a word: from epsilon, delta and the number of distinct words."""
    p = 1 - math.exp(-config.epsilon)
    top = config.log2_delta - math.log2(0.5 - p / 4)
    return F.ceil((F.lit(top) - F.log2(n_words.cast("double"))) / math.log2(1 - p)).cast("int")


def gamma(u: Column, alpha: Column, config: Config = Config(), exact: bool = False) -> Column:
    """Dummies of a word from a uniform number, in [0, 2 alpha]: geometric on the right; on the left one step, or with
    `exact` geometric too."""
    p = 1 - math.exp(-config.epsilon)
    tail = 0.5 - p / 4
    right = F.ceil(F.ln((1 - u) / tail) / math.log(1 - p))
    left = -F.ceil(F.ln(u / tail) / math.log(1 - p)) if exact else F.lit(-1)
    k = F.when(u <= tail, left).when(u <= 1 - tail, F.lit(0)).otherwise(right)
    return F.least(F.greatest(k.cast("int") + alpha, F.lit(0)), 2 * alpha)


def dummies(vocabulary: DataFrame, config: Config = Config()) -> DataFrame:
    """Rows with owner -1 for each word of each question."""
    size = vocabulary.groupBy("question_id").agg(F.count("*").alias("n_words"))
    words = vocabulary.join(size, "question_id").withColumn("alpha", gamma_alpha(F.col("n_words"), config))
    drawn = words.withColumn("n", gamma(uniform(config.seed + ":gamma", "question_id", "content"), F.col("alpha"), config))
    rows = drawn.where("n > 0").select("question_id", F.lit(-1).cast("long").alias("owner_id"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"), "content")
    return rows


def with_dummies(words: DataFrame, config: Config = Config()) -> DataFrame:
    cols = ["question_id", "owner_id", "pos", "content"]
    return words.select(*cols).unionByName(dummies(vocabulary(words), config).select(*cols))


def without_dummies(words: DataFrame) -> DataFrame:
    return words.where("owner_id <> -1")


def shuffle_key(seed: str, *ids: str) -> Column:
    return hash32(F.concat_ws("|", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def shuffled(words: DataFrame, seed: str = "shuffle") -> DataFrame:
    """Place of each row of a question in an order by hash of its values; by ranges, where a question is large."""
    order = [shuffle_key(seed, "question_id", "owner_id", "pos", "content"), F.col("owner_id"), F.col("pos")]
    return places(words, ["question_id"], order, fits=FITS)


def ordered(words: DataFrame, *keys: Column | str, descending: bool = False) -> DataFrame:
    """Place of each row of a question in the order of any keys, ties by owner and position; by ranges, where a question is large."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    order = [c.desc() if descending else c.asc() for c in cols]
    ties = [F.col(c) for c in ("owner_id", "pos") if c in words.columns]
    return places(words, ["question_id"], [*order, *ties], fits=FITS)
