"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again for the next one. All but the last return the columns of
`documents`. ORACLE_SQL is None: SQL can express neither the language model nor
weighted sampling nor the tokenizer; tests/llm compares the stages with brute force.

Documents can have other columns of any type and name, which all stages but the last hand on, and lack any but doc_id and
text. Nulls: rows without a text stay until packing; rows without an id are known by their text. Texts of any length
are handled whole. An empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm.decontam import contamination
from candor.llm.langid import accepted
from candor.llm.neardup import near_duplicates
from candor.llm.packing import pack_documents
from candor.llm.shared import clean, quoted, scope, small_side, stored
from candor.llm.substring import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects."""
    return accepted(docs)


def _keys() -> list[Column]:
    """What tells rows apart, 128 bits: rows of the same id and text are the same document, others are not, even if they
    share an id or have none. Operators know a row by the first 64 bits, and the other 64 show where two rows have these alike."""
    return [F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("other_key")]


def _keyed(docs: DataFrame) -> DataFrame:
    """The keys, and the row itself as a struct, whatever its columns are called and of whatever type they are."""
    return docs.select(*_keys(), F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row"))


def _rows(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.select(*[F.col("row").getField(c).alias(c) for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the smallest id, before rows without an id.
    Of rows with the same id and text one stays. Rows without a text all stay. Rows that have the first 64 bits of
    their keys by chance stay too: no text is lost for another's."""
    keyed = _keyed(docs)
    some = keyed.where(F.col("row").getField("text").isNotNull()).select("row_key", "other_key", F.col("row").getField("doc_id").alias("doc_id"), F.col("row").getField("text").alias("text"))
    found = near_duplicates(some.select("row_key", "text"), id_col="row_key").where("doc_id <> class_id").select(F.col("doc_id").alias("row_key"), "class_id").distinct()
    found = stored(found, "classes")
    members = found.unionByName(found.select(F.col("class_id").alias("row_key"), "class_id").distinct())
    ids = small_side(members).join(some.select("row_key", "doc_id"), "row_key")
    stays = ids.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")).select("least.row_key")
    several = some.groupBy("row_key").agg(F.count("*").alias("n"), (F.min("other_key") < F.max("other_key")).alias("chance")).where("n > 1")
    several = stored(several, "repeated")
    gone = members.join(stays, "row_key", "left_anti").join(several.where("chance").select("row_key"), "row_key", "left_anti")
    gone = stored(gone.select("row_key"), "gone")
    kept = keyed.join(small_side(gone), "row_key", "left_anti")
    if several.isEmpty():
        return _rows(kept, docs.columns)
    repeated = small_side(several.select("row_key"))
    # any of them, by its place in its task: rows can have columns that have no order
    first = kept.join(repeated, "row_key", "left_semi").withColumn("place", F.monotonically_increasing_id())
    first = first.groupBy("row_key", "other_key").agg(F.min_by("row", "place").alias("row"))
    return _rows(kept.join(repeated, "row_key", "left_anti"), docs.columns).unionByName(_rows(first, docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of repeated passages out of the texts; the words left are joined by one space."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, rest=carried)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("rest.n_chars"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": n_chars}
    return found.select(*[made.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that passages of the benchmark contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row_key, other_key = _keys()
    found = contamination(docs.select(row_key.alias("doc_id"), "text"), benchmark)
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias("row_key")).distinct(), "gone")
    keyed = _keyed(docs)
    # several rows of one key: their other keys tell which of them it is
    hit = keyed.join(small_side(gone), "row_key").groupBy("row_key").agg((F.min("other_key") < F.max("other_key")).alias("chance")).where("chance")
    chance = stored(hit.select("row_key"), "chance")
    kept = keyed.join(small_side(gone), "row_key", "left_anti")
    if chance.isEmpty():
        return _rows(kept, docs.columns)
    both = keyed.join(small_side(chance), "row_key", "left_semi")
    again = contamination(both.select(F.col("other_key").alias("doc_id"), F.col("row").getField("text").alias("text")), benchmark)
    clean_ones = stored(again.where(~F.col("contaminated")).select(F.col("doc_id").alias("other_key")).distinct(), "clean")
    return _rows(kept, docs.columns).unionByName(_rows(both.join(small_side(clean_ones), "other_key", "left_semi"), docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Of each stage only its result stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope() as made:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name)
            clean(spark, made, keep=1)
        return STAGES[-1][1](spark, docs, sf_dir)
