"""A training corpus from ``documents``: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.llm.common import numbered_rows, without, written
from boxwise.llm.exact_dedup import exact_dedup
from boxwise.llm.mixing import emit_mix
from boxwise.llm.ngram_join import near_duplicates
from boxwise.llm.packing import pack
from boxwise.llm.toxicity import without_toxic
from boxwise.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose restored text scores 0.7 or more.

    Row by row: repeated rows, null ids and extra columns stay as they are; a
    null text scores as an empty one, which stays unless the labels say that
    such texts are toxic; texts of any length are read whole. Without labels
    nothing goes, and an empty table stays empty.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased, null as empty) the one with the largest id.

    The choice is among rows: of rows with the largest id, and of rows that
    repeat in all columns, one stays, and a row with another text stays even
    if it has the id of one that goes. A null id is less than any other.
    Whole texts of any length are compared. An empty table stays empty.
    """
    return _one_row_of_each(docs, lambda rows: exact_dedup(rows, "own", keep="max").select("own", F.col("keep_id").alias("kept_row")), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id.

    The choice is among rows, as in ``drop_copies``; a null id is less than
    any other. A text without words (null, empty, signs alone) is in a class
    of its own and stays. An empty table stays empty.
    """
    return _one_row_of_each(docs, lambda rows: near_duplicates(rows, "own").select("own", F.col("class_id").alias("kept_row")), "classes")


def _one_row_of_each(docs: DataFrame, groups, name: str) -> DataFrame:
    """The rows that ``groups`` (of rows: own, text) names as kept for themselves."""
    rows = numbered_rows(docs)
    own = F.struct(F.col("row.doc_id").alias("doc_id"), "at.file", "at.line")  # the id decides, then the place
    found = written(groups(rows.select(own.alias("own"), F.col("row.text").alias("text"))), name)
    gone = found.where("own <> kept_row").select(F.struct("own.file", "own.line").alias("at"))
    return without(rows, "at", gone).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source. Documents without words, null texts among
    them, weigh nothing and are taken by their source's rate as any other.
    Repeated rows and ids draw alike, null ids as empty text. Extra columns
    are carried. An empty table stays empty.
    """
    return emit_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their ids.

    Every row is a document of its own, repeated or with a null id; a null or
    empty text is the end id alone, and long texts span sequences. Of the
    columns only the id goes on. An empty table gives no pieces.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: A language model and a classifier decide in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
