"""The corpus pipeline: quality rules, line dedup, near copies, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next one starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.decontam import contamination
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.mixing import mixed_documents
from spanloom.llm.ngram_join import drop_near_copies
from spanloom.llm.quality import judge_quality
from spanloom.llm.words import HAS_WORD
from spanloom.scratch import fresh, materialize, remove, shared_dir, small_side, tables


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and source of ``docs``, and all its columns as one, so that no operator meets a name of its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` from its packed form, with some replaced."""
    return [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep.

    A null or empty text fails the base rules; each of repeated rows is judged
    alike, by its text.  Without labels of both classes the base rules decide
    alone.  An empty table gives an empty one.
    """
    judged = judge_quality(_packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("quality.kept").select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document of which no line with words is left goes.

    A null text, or one without words from the start, stays as it is.  Of
    repeated rows one keeps its lines, so the others go.  A null id is the
    first; of equal ids the content hash decides.
    """
    out = dedup_lines(_packed(docs))
    emptied = (F.size("removed_lines") > 0) & ~F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    return out.where(~emptied).select(*_columns(docs, text=F.col("text")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near copies.

    Documents without words, of null texts too, all stay.  Of repeated rows one
    stays; a null id is the least.
    """
    return drop_near_copies(_packed(docs)).select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts have none and stay; repeated rows stay or go together,
    rows of one id and another text by themselves.  Without items all stay.
    """
    keyed = _packed(docs).withColumn("key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")))
    found = contamination(keyed.select("key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").where("n_hit > 0")
    hit = materialize(found.select(F.col("key.id").alias("hid"), F.col("key.th").alias("hth")).distinct(), "contaminated")
    same = keyed["key.id"].eqNullSafe(hit["hid"]) & (keyed["key.th"] == hit["hth"])
    return keyed.join(small_side(hit), same, "left_anti").select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with the number of the copy from 0 in a column ``copy`` (``_copy`` if there is one).

    A null source is a source; texts without words aren't taken.  Repeated rows
    are each taken as often as their rounding says.
    """
    (name,) = fresh(docs, "copy")
    return mixed_documents(_packed(docs)).select(*_columns(docs), F.col("copy").alias(name))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: SQL can't train the classifier or prune by MinHash; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/spanloom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with tables(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
