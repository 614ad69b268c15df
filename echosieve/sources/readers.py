"""Sources: markdown and text files, and tables, as (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.config import HISTORY_LIMIT, Settings


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id, text, path): every matching file under path, or the one file it names, as
    one row; doc_id is its path, so an order by it is the order of the names. A missing
    path is an error."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return rows.select(name.alias("doc_id"), F.col("value").alias("text"), name.alias("path"))


def read_checked(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(doc_id, text, error): files as read_markdown gives them; one that is not UTF-8 has
    an error instead of a text."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return rows.select(F.col("path").alias("doc_id"), F.when(ok, text).alias("text"), F.when(~ok, F.lit("not UTF-8")).alias("error"))


def read_book(spark: SparkSession, book: str | None = None, file: str | None = None, root: str = "content") -> DataFrame:
    """One document, of a book's slug or a path: exactly one of both must be given."""
    if (book is None) == (file is None):
        raise ValueError("give exactly one of book and file")
    return read_markdown(spark, f"{root}/{book}.md" if book else file, "*")


def read_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def read_settings(spark: SparkSession, path: str) -> Settings:
    """Saved settings, one small JSON file; defaults for what is missing or invalid."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return Settings.from_json(rows[0][0] if rows else None)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The run log, newest first; unreadable rows are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("created_at")).limit(HISTORY_LIMIT)
