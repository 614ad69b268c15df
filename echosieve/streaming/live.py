"""Texts that arrive over time: an extension, since the batch engine has no streams.

Rewriting a document needs only the document (and a static model), so a stream is
handled in micro-batches by the batch plan itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echosieve.config import Settings
from echosieve.operators.diagnostics import pattern_flags
from echosieve.operators.fragments import fragments
from echosieve.plans.pipeline import analyze


def read_texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def rewrite_stream(docs: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), models: DataFrame | None = None) -> StreamingQuery:
    """Append (batch, metrics and rewritten texts) of every micro-batch to Parquet at out.
    A batch that is run again overwrites its own folder, so files are exactly once."""

    def one(batch: DataFrame, number: int) -> None:
        a = analyze(batch, settings, models=models)
        a.applied.join(a.metrics, "doc_id").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flag_batch(batch: DataFrame) -> DataFrame:
    """The flags of a micro-batch's fragments."""
    return pattern_flags(fragments(batch))
