"""Files of a grading corpus: text lines, directories named by question, word vectors.

Line numbers come from the order of lines in a file. Spark splits a text file at blocks and keeps
the lines of a block together, in order of monotonically_increasing_id; the blocks' counts are
summed within a file, so that no task sees more of a file than a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candor.config import EXAM_SIZES
from candor.functions.text import STOPWORDS, strip_id
from candor.functions.vector import normalised


def _lines(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Lines with their file, the block of the file, and an id that ascends within the block."""
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("recursiveFileLookup", deep).text(path).select(*at, F.monotonically_increasing_id().alias("id"), "value")


def numbered_lines(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """path, file (its name), line (from 0) and value of all lines of a file, or of a directory's files, with `deep` at any depth."""
    lines = _lines(spark, path, deep)
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    blocks = blocks.select("path", "block", (before - F.col("first")).alias("shift"))
    return lines.join(blocks, ["path", "block"]).select("path", "file", (F.col("id") + F.col("shift")).alias("line"), "value")


def questions(spark: SparkSession, path: str, factors: int = 30) -> DataFrame:
    return numbered_lines(spark, path).select(F.col("line").alias("question_id"), F.col("value").alias("content"), F.lit(factors).alias("key_factor_number"))


def _file_id() -> Column:
    """The number of a folder question_id=N, else the one that a file name starts with, else 0."""
    number = lambda c, pattern, group: F.regexp_extract(c, pattern, group).try_cast("int")
    return F.coalesce(number("path", "/question_id=(\\d+)/[^/]*$", 1), number("file", "^\\d+", 0), F.lit(0))


def answers(spark: SparkSession, directory: str) -> DataFrame:
    """One answer for each line, empty ones too; its owner is the line's number."""
    return numbered_lines(spark, directory).select(_file_id().alias("question_id"), F.col("line").alias("owner_id"), F.col("value").alias("raw_answer"))


def numbered_words(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """path, file, place (from 0) and word of all words between white space of a file, or of a directory's files.

    Words are counted within blocks and the blocks' counts summed, as lines are."""
    lines = _lines(spark, path, deep).withColumn("words", F.filter(F.split("value", "\\s+"), lambda w: w != ""))
    lines = lines.where(F.size("words") > 0).select("path", "file", "block", "id", "words", F.size("words").alias("n"))
    within = F.sum("n").over(Window.partitionBy("path", "block").orderBy("id")) - F.col("n")
    blocks = lines.groupBy("path", "block").agg(F.sum("n").alias("n"))
    before = blocks.select("path", "block", (F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")).alias("before"))
    rows = lines.withColumn("within", within).join(before, ["path", "block"])
    return rows.select("path", "file", (F.col("before") + F.col("within")).alias("at"), F.posexplode("words").alias("k", "word")).select("path", "file", (F.col("at") + F.col("k")).alias("place"), "word")


def scores(spark: SparkSession, directory: str) -> DataFrame:
    """Numbers between white space, counted through a file."""
    words = numbered_words(spark, directory)
    return words.select(_file_id().alias("question_id"), F.col("place").alias("owner_id"), F.col("word").cast("float").alias("score"))


#: A folder named `exam.item`, in it a file for each grader; Spark's writer makes folders id=exam.item/grader=name of it
_TREE = "/(?:id=)?([0-9]+\\.[0-9]+)/(?:grader=)?([^/]+?)(?:/part-[^/]*)?$"


def raw_scores(spark: SparkSession, directory: str) -> DataFrame:
    """id, grader, line, score of a raw tree: a folder `exam.item` for each question, a file of numbers for each grader."""
    words = numbered_words(spark, directory, deep=True)
    part = lambda k: F.regexp_extract("path", _TREE, k)
    return words.select(part(1).alias("id"), part(2).alias("grader"), F.col("place").alias("line"), F.col("word").cast("float").alias("score")).where("id <> ''")


def raw_answers(spark: SparkSession, directory: str) -> DataFrame:
    """id, line, raw_answer of a folder with a file `exam.item` for each question, whose lines begin with an id of their own."""
    lines = numbered_lines(spark, directory, deep=True)
    name = F.regexp_extract("path", "/(?:id=)?([0-9]+\\.[0-9]+)(?:/part-[^/]*)?$", 1)
    return lines.select(name.alias("id"), "line", strip_id(F.col("value")).alias("raw_answer")).where("id <> ''")


def save_raw_tree(rows: DataFrame, path: str, *folders: str, order: str = "line", value: str = "value") -> None:
    """Writes a text file for each combination of the folder columns, its lines in order, as raw_scores() and raw_answers() read it."""
    lines = rows.select(*folders, F.col(order).alias("at"), F.col(value).cast("string").alias("value"))
    lines.repartition(*folders).sortWithinPartitions(*folders, "at").drop("at").write.partitionBy(*folders).text(path)


def collected_tree(spark: SparkSession, directory: str, grader: str = "ave", exclude: tuple[str, ...] = ()) -> DataFrame:
    """question_id, owner_id, id, score of one grader's files of a raw tree, questions by the place of their id."""
    rows = raw_scores(spark, directory).where(F.col("grader") == grader)
    return collected_scores(rows, exclude=exclude).select("question_id", "owner_id", "id", "score")


def dataset(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of a corpus directory."""
    return {
        "questions": questions(spark, f"{root}/questions/questions"),
        "answers": answers(spark, f"{root}/answers"),
        "scores": scores(spark, f"{root}/scores"),
        "exams": exams(spark),
        "stopwords": stopwords(spark),
    }


def save_lines(rows: DataFrame, path: str, question: str = "question_id", order: str = "owner_id", value: str = "value") -> None:
    """Writes a text file for each question, its lines in order, into folders that answers() and scores() read."""
    lines = rows.select(F.col(question).alias("question_id"), F.col(order).alias("at"), F.col(value).cast("string").alias("value"))
    lines.repartition("question_id").sortWithinPartitions("question_id", "at").drop("at").write.partitionBy("question_id").text(path)


def unique_answers(answers: DataFrame, order: str = "raw_answer") -> DataFrame:
    """One answer for each question and owner: the first in the order given, by text where there are more of that."""
    first = F.min(F.struct(F.col(order).alias("at"), "raw_answer"))["raw_answer"]
    return answers.groupBy("question_id", "owner_id").agg(first.alias("raw_answer"))


def raw_word_model(spark: SparkSession, path: str) -> DataFrame:
    """word, vec (unit length) of lines `word f1 f2 ...`; of a repeated word the last line counts."""
    lines = _lines(spark, path).select("path", "block", "id", F.filter(F.split("value", "\\s+"), lambda w: w != "").alias("w")).where("size(w) > 1")
    rows = lines.select(F.col("w")[0].alias("word"), F.struct("path", "block", "id").alias("at"), F.expr("slice(w, 2, size(w) - 1)").cast("array<double>").alias("v"))
    return rows.groupBy("word").agg(F.max_by("v", "at").alias("v")).select("word", normalised(F.col("v")).cast("array<float>").alias("vec"))


def load_word_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_word_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def exams(spark: SparkSession, sizes: tuple[int, ...] = EXAM_SIZES) -> DataFrame:
    rows = [(k + 1, sum(sizes[:k]), n) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "exam_id int, first_question int, n_questions int")


def renumbered(ids: DataFrame, column: str = "id") -> DataFrame:
    """exam, item and place (from 0) of ids `exam.item`, ordered as two numbers, so that 11.10 follows 11.9.

    Ids are numbered within an exam and exams by a running sum of their sizes, so that no task sees all ids."""
    parts = F.split(F.col(column), "\\.")
    split = ids.select(F.col(column).alias("id"), parts[0].cast("int").alias("exam"), parts[1].cast("int").alias("item")).distinct()
    sizes = split.groupBy("exam").agg(F.count("*").alias("n"))
    before = sizes.select("exam", (F.sum("n").over(Window.orderBy("exam")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("exam").orderBy("item")) - 1
    return split.withColumn("within", place).join(before, "exam").select("id", "exam", "item", (F.col("before") + F.col("within")).cast("long").alias("place"))


def collected_scores(scores: DataFrame, column: str = "id", exclude: tuple[str, ...] = ()) -> DataFrame:
    """The score rows with question_id, the place of their id `exam.item` among all that are not excluded, and owner_id,
    their place among the id's rows by `line`."""
    kept = scores.where(~F.col(column).isin(*exclude)) if exclude else scores
    places = renumbered(kept, column).select(F.col("id").alias(column), F.col("place").alias("question_id"))
    owner = F.row_number().over(Window.partitionBy(column).orderBy("line")) - 1
    return kept.withColumn("owner_id", owner.cast("long")).join(places, column)


def stripped(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.withColumn(column, strip_id(F.col(column)))


def series(lines: DataFrame, per_exam: int = 10) -> DataFrame:
    """exam_id, top_k, score of numbered lines with one number each, exam after exam."""
    return lines.select(F.expr(f"line div {per_exam} + 1").cast("int").alias("exam_id"), (F.pmod("line", F.lit(per_exam)) + 1).cast("int").alias("top_k"), F.col("value").cast("double").alias("score"))


def paired(plain: DataFrame, other: DataFrame, names: tuple[str, str] = ("plain", "padded")) -> DataFrame:
    """Two series side by side, by exam and K."""
    return plain.withColumnRenamed("score", names[0]).join(other.withColumnRenamed("score", names[1]), ["exam_id", "top_k"])


def tidy(**series: DataFrame) -> DataFrame:
    """exam_id, top_k, variant, score: series one below the other, by the names given."""
    rows = [s.select("exam_id", "top_k", F.lit(name).alias("variant"), "score") for name, s in series.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def save_results(results: DataFrame, path: str) -> DataFrame:
    """Writes results as Parquet; gives them back as they read from there."""
    results.write.mode("overwrite").parquet(path)
    return results.sparkSession.read.schema(results.schema).parquet(path)


def label_counts(lines: DataFrame, marker: str = ";Edge") -> DataFrame:
    """file, zero, nonzero: labels of numbered lines before a file's first line that starts with the marker."""
    stop = lines.where(F.col("value").startswith(marker)).groupBy("file").agg(F.min("line").alias("stop"))
    label = F.regexp_extract("value", "^([0-9]+)", 1)
    rows = lines.join(stop, "file", "left").where((F.col("stop").isNull() | (F.col("line") < F.col("stop"))) & F.col("value").rlike("^[0-9]"))
    return rows.groupBy("file").agg(F.count_if(label.cast("int") == 0).alias("zero"), F.count_if(label.cast("int") != 0).alias("nonzero"))


def label_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("zero").alias("zero"), F.sum("nonzero").alias("nonzero"))
