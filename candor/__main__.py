"""python -m candor CORPUS VECTORS: truth discovery over the files of a grading corpus, graded for each K.

VECTORS is a text file of word vectors or a saved model (a Parquet folder). Prints the mean grade of each exam's best
answers for K from 1 to --top, and writes it as Parquet where --out says."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from candor.config import Config
from candor.operators import scoring
from candor.plans.discovery import discover
from candor.sources import corpus


def graded(spark: SparkSession, root: str, word_model: DataFrame, mode: str = "plain", top: int = 10, config: Config | None = None) -> DataFrame:
    """exam_id, top_k, average: answers are ranked once, and the best K of them graded for each K."""
    data = corpus.dataset(spark, root)
    answers = corpus.unique_answers(data["answers"])
    found = discover(answers, word_model, data["stopwords"], config or Config(top_k=top), mode)
    exam = scoring.exam_of(data["questions"], data["exams"])
    return scoring.exam_report(scoring.top_answers(found.answer_scores, top), data["scores"], exam, top)


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="candor", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("corpus")
    args.add_argument("vectors")
    args.add_argument("--mode", choices=["plain", "padded"], default="plain")
    args.add_argument("--top", type=int, default=10)
    args.add_argument("--out")
    args.add_argument("--saved", action="store_true", help="VECTORS is a saved model")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("candor").getOrCreate()
    model = corpus.load_word_model(spark, a.vectors) if a.saved else corpus.raw_word_model(spark, a.vectors)
    began = time.perf_counter()
    report = graded(spark, a.corpus, model, a.mode, a.top)
    if a.out:
        report = corpus.save_results(report, a.out)
    for r in report.orderBy("top_k", "exam_id").collect():
        print(f"top {r.top_k} exam {r.exam_id} average {r.average:.5f}")
    print(f"{time.perf_counter() - began:.3f} s")


if __name__ == "__main__":
    main()
