"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of `documents`; extra columns of the
input are not carried, whatever their names. Null and empty texts go through every stage and end as a sequence's closing
token; empty tables stay empty. Texts of any length are worked on whole. Rows of equal id and text are one document to
the stages that compare documents: line dedup treats them alike, near-dedup keeps one of them; the other stages judge
every row for itself. Ties go to the least doc_id (null ids last in near-dedup, first in line dedup), then to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.decontaminate import cut_spans, decontaminate
from larkspur.llm.lines import repeated_lines
from larkspur.llm.nearcopies import one_of_each
from larkspur.llm.packing import pack
from larkspur.llm.quality import score_quality, train
from larkspur.llm.runtime import stored, table, tuned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(df: DataFrame, text: str = "text") -> DataFrame:
    """COLUMNS with the text in column `text` and its own number of characters (a null text keeps what it had)."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.coalesce(F.length(text).cast("bigint"), F.col("n_chars").cast("bigint")).alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without any label all stay. Equal texts are judged alike."""
    tuned(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of line runs go from the texts; a document that is left without lines stays, as an empty text."""
    return _sized(repeated_lines(docs, keep=("doc_id", "lang", "source", "n_chars")), "kept")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of least doc_id; texts without words are only equal to their like."""
    return one_of_each(docs, COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that the benchmark holds go from the texts; nothing goes where the benchmark is empty."""
    return _sized(cut_spans(docs, decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document is placed in a sequence, repeated rows included."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL expresses a trained classifier or the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
