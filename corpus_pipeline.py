"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

quality -> exact_dedup -> near_dedup -> decontaminate -> encode. Every stage but the last returns the
columns of documents; each works on all that the one before kept. A stage decides on rows, not on ids:
quality and decontaminate judge a row where it is; the deduplications name each row by its file and
place, and the rows that stay are joined by that name, so rows that repeat a doc_id or have none keep
their own decisions. In every stage a null text is empty, an empty table stays empty, and other columns
of documents go along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.llm.common import materialize, read_table, with_row_names
from quillfind.llm.decontaminate import clean_rows
from quillfind.llm.exact_dedup import exact_groups
from quillfind.llm.near_dedup import near_duplicates
from quillfind.llm.pieces import encode_pieces
from quillfind.llm.quality import THRESHOLD, score_column, train


def _staying(docs: DataFrame, groups, keep: str) -> DataFrame:
    """The rows of docs that groups(docs, row), a row for each row of docs, marks in its column keep."""
    named, row = with_row_names(docs)
    kept = groups(named, row=row).where(keep).select(F.col("file").alias(row[0]), F.col("place").alias(row[1]))
    return named.join(kept, list(row)).select(*[named[c] for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier (operator 5) rejects.

    Without labels every score is 0.5, below the threshold, so every document goes.
    """
    return docs.where(score_column(spark, train(docs, read_table(spark, sf_dir, "labels"))) >= THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the smallest doc_id (operator 10); a null one ranks last, of ties one row stays."""
    return _staying(docs, exact_groups, "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies keep the row with the smallest doc_id (operator 2); a null one ranks last, of ties one row stays."""
    return _staying(docs, near_duplicates, "stays")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a window of any benchmark item occurs (operator 8's n_hit), named or not."""
    return clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, and whether decoding gives the text back (operator 7)."""
    import public_tokenizers

    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The classifier's decisions cannot be stated in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
