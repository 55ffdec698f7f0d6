"""Markdown files as a table, and blocks of raw text where no section list is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.functions.text import anchor_id, lines_of


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, name, base_name, text of every .md file below path, whole texts, empty files too.

    Spark's own listing leaves empty files out, so those are taken from the file system's.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    files = files.select("path", F.decode("content", "UTF-8").alias("text"))
    empty = _empty_files(spark, path)
    if empty:
        files = files.unionByName(spark.createDataFrame([(p, "") for p in empty], "path string, text string"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.md$", "").alias("base_name"), "text")


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(".md"):
            out.append(f.getPath().toString())
    return out


def line_kind(line):
    """The kind of block that a line of markdown is."""
    return (
        F.when(line.rlike(r"^\s*#{1,6} "), "heading")
        .when(line.rlike(r"^\s*([-*+]|\d+[.)]) "), "list")
        .when(line.rlike(r"^\s*>"), "blockquote")
        .when(line.rlike(r"^\s*```"), "code")
        .when(line.rlike(r"^\s*\|"), "table")
        .when(line.rlike(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$"), "thematicBreak")
        .otherwise("paragraph")
    )


def blocks_of_lines(notes: DataFrame, now) -> DataFrame:
    """A block for each line that is not blank, with its kind and offsets, and with its note's path and name where those are given."""
    names = [c for c in ("path", "name") if c in notes.columns]
    rows = notes.select(F.col("id").alias("note_id"), *[F.col(c).alias(f"note_{c}") for c in names], F.posexplode_outer(lines_of("text")).alias("ordinal", "line")).select("*", "line.*").drop("line")

    def place(col, offset):
        return F.struct(F.col("ordinal").alias("line"), col.cast("int").alias("col"), offset.cast("int").alias("offset"))

    return rows.where(F.trim("content") != "").select(
        F.concat_ws("#", "note_id", F.col("ordinal").cast("string")).alias("id"),
        "note_id",
        now.alias("created_at"),
        now.alias("updated_at"),
        "ordinal",
        line_kind(F.col("content")).alias("type"),
        "content",
        anchor_id(F.col("content")).alias("anchor_id"),
        place(F.lit(0), F.col("end") - F.length("content")).alias("start_position"),
        place(F.length("content"), F.col("end")).alias("end_position"),
        *[f"note_{c}" for c in names],
    )
