"""The model's tables from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor.functions.rng import hash32
from candor.functions.text import tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a question, its turns are answers."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("owner_id"), F.col("text").alias("raw_answer"))


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a question, its documents in order of doc_id are answers."""
    docs = table(spark, sf_dir, "documents")
    owner = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    narrow = docs.select("doc_id", "source").withColumn("owner_id", owner.cast("long"))  # the window sorts ids only
    return docs.select("doc_id", "text").join(narrow, "doc_id").select(F.regexp_extract("source", "(\\d+)", 1).cast("long").alias("question_id"), "owner_id", F.col("text").alias("raw_answer"), "doc_id")


def hashed_word_model(answers: DataFrame, embeddings: DataFrame) -> DataFrame:
    """word, vec_id, vec: every word of the answers gets a vector by hash; a tenth of them has none."""
    words = answers.select(F.explode(tokens(F.col("raw_answer"))).alias("word")).distinct()
    n = embeddings.agg(F.count("*").alias("n_vectors"))
    known = words.where(hash32(F.col("word"), 9, 4) % 10 != 0).join(F.broadcast(n))  # one row
    placed = known.select("word", (hash32(F.col("word")) % F.col("n_vectors")).alias("vec_id"))
    return placed.join(embeddings.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select("word", "vec_id", "vec")
