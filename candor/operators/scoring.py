"""Scores of answers and owners, the best answers, and agreement with grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def true_words(answers: DataFrame, words: DataFrame, truth: DataFrame) -> DataFrame:
    """question_id, owner_id, n_true: keyword occurrences in true clusters, 0 for answers without any."""
    hits = words.join(truth.where("indicator = 1").select("question_id", F.col("factor").alias("cluster")), ["question_id", "cluster"], "left_semi")
    count = hits.groupBy("question_id", "owner_id").agg(F.count("*").alias("n_true"))
    return answers.select("question_id", "owner_id").distinct().join(count, ["question_id", "owner_id"], "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))


def normalised_scores(counts: DataFrame) -> DataFrame:
    """Share of the question's total; a question whose total is 0 keeps its zeros.

    The total is a sum that combines before the shuffle and joins back, not a window over a question's rows."""
    total = counts.groupBy("question_id").agg(F.sum("n_true").alias("total"))
    share = F.when(F.col("total") > 0, F.col("n_true") / F.col("total")).otherwise(F.col("n_true").cast("double"))
    return counts.join(total, "question_id").select("question_id", "owner_id", share.alias("score"))


def owner_trust(scores: DataFrame) -> DataFrame:
    return scores.groupBy("owner_id").agg(F.sum("score").alias("trust"))


def top_answers(scores: DataFrame, k: int, key: Column | None = None) -> DataFrame:
    """The k best of each question with their rank; ties go to the lower owner. Fewer rows where there are fewer answers."""
    order = Window.partitionBy("question_id").orderBy((F.col("score") if key is None else key).desc(), F.col("owner_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def truncated(score: Column) -> Column:
    """To a millionth, as masked comparison sees scores."""
    return F.floor(score * 1e6) / 1e6


def masked_select(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def exam_of(questions: DataFrame, exams: DataFrame) -> DataFrame:
    """exam_id, question_id: the questions in order of id, dealt to exams by their sizes. Later ones have no exam.

    Only as many questions as the exams hold are sorted together."""
    most = exams.agg(F.max(F.col("first_question") + F.col("n_questions"))).first()[0] or 0
    few = questions.select("question_id").distinct().orderBy("question_id").limit(most)
    placed = few.withColumn("place", F.row_number().over(Window.orderBy("question_id")) - 1)
    inside = (F.col("place") >= F.col("first_question")) & (F.col("place") < F.col("first_question") + F.col("n_questions"))
    return placed.join(F.broadcast(exams), inside).select("exam_id", "question_id", "n_questions")


def exam_scores(top: DataFrame, grades: DataFrame, exam: DataFrame, k: int) -> DataFrame:
    """exam_id, average: sum of the top answers' grades over k times the exam's questions, whatever is missing."""
    graded = top.where(F.col("rank") <= k).join(grades, ["question_id", "owner_id"]).join(exam, "question_id")
    return graded.groupBy("exam_id").agg((F.sum("score") / (k * F.max("n_questions"))).alias("average"))


def exam_report(ranked: DataFrame, grades: DataFrame, exam: DataFrame, most: int) -> DataFrame:
    """exam_id, top_k, average for each K from 1 to `most`: the grades are joined once, and an answer counts for every K from its rank on."""
    graded = ranked.where(F.col("rank") <= most).select("question_id", "owner_id", "rank").join(grades, ["question_id", "owner_id"]).join(exam, "question_id")
    by_k = graded.withColumn("top_k", F.explode(F.sequence(F.col("rank"), F.lit(most))))
    return by_k.groupBy("exam_id", "top_k").agg((F.sum("score") / (F.col("top_k") * F.max("n_questions"))).alias("average"))


def overall_score(top: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    return top.where(F.col("rank") <= k).join(grades, ["question_id", "owner_id"]).agg(F.avg("score").alias("average"))


def most_answers(answers: DataFrame) -> DataFrame:
    return answers.groupBy("question_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
