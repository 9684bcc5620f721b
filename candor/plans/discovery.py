"""Truth discovery from answers to scores."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor import checkpoints
from candor.config import Config
from candor.operators import clustering, keywords, kmeans, scoring, truth


class Discovery(NamedTuple):
    words: DataFrame  # question_id, owner_id, pos, content, cluster
    truth: DataFrame  # question_id, factor, indicator
    answer_scores: DataFrame  # question_id, owner_id, score
    owner_scores: DataFrame  # owner_id, trust
    top: DataFrame  # question_id, owner_id, score, rank


def clustered(words: DataFrame, word_model: DataFrame, config: Config, centroids: DataFrame | None = None, grouped: bool = False) -> DataFrame:
    """words with the cluster of each: by the centroids given, else by k-means of each question, in which dummies weigh nothing.

    grouped: a question's k-means in one pandas group, instead of steps that distribute."""
    if centroids is not None:
        model = clustering.assigned(word_model, centroids).select(F.col("word").alias("content"), "cluster")  # a word once, not for each question
        return words.join(model, "content")
    distinct = keywords.weighed_words(words)
    if grouped:
        found = clustering.kmeans_grouped(keywords.with_vectors(distinct, word_model), config)
    else:
        found = kmeans.clusters(checkpoints.cut(distinct), word_model, config.clusters, f"{config.seed}:kmeans", config.max_iter, config.tolerance)
    return words.join(found.select("question_id", "content", "cluster"), ["question_id", "content"])


def discover(
    answers: DataFrame,
    word_model: DataFrame,
    stopwords: DataFrame,
    config: Config = Config(),
    mode: str = "plain",
    centroids: DataFrame | None = None,
    inference: str = "draw",
    sweeps: int | None = None,
    grouped: bool = False,
) -> Discovery:
    """mode 'padded' adds dummy words first, filters late, takes the dummies through k-means without weight and drops
    them after it: the statistics stay the same. inference: 'draw' or 'map' (synchronous sweeps), or 'gibbs' (the
    sequential chain, one task). Uniform numbers come from hashes, so that the same input gives the same result."""
    if mode == "padded":
        word_model = checkpoints.cut(word_model)  # read by the filter and by k-means
        words = checkpoints.cut(keywords.unpadded(keywords.padded(checkpoints.cut(keywords.tokenized(answers)))))
        words = keywords.with_dummies(words, config)  # rows that are counted as they come and are not written
        words = keywords.filtered(words, stopwords, word_model)  # rows have no order here that a shuffle could hide
    elif mode == "plain":
        words = keywords.keywords(answers, stopwords)  # the join with vectors drops the others
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if centroids is None and mode == "plain":
        words = checkpoints.cut(words)  # read by k-means and by the join with its clusters
    words = clustered(words, word_model, config, centroids, grouped)
    words = checkpoints.cut(keywords.without_dummies(words))  # read by inference and by scoring
    observed = truth.packed(answers, words, config.clusters)
    if inference == "gibbs":
        inferred = truth.gibbs(truth.unpacked(observed, config.clusters), config)
    else:
        inferred = truth.synchronous(observed, sweeps or config.sweeps, config, inference == "draw", config.clusters)
    scores = scoring.normalised_scores(scoring.true_words(answers, words, inferred))
    return Discovery(words, inferred, scores, scoring.owner_trust(scores), scoring.top_answers(scores, config.top_k))
