"""Corpus pipeline: quality, near copies, repeated passages, benchmark leaks, tokens.

STAGES lists (name, function(spark, docs, sf_dir) -> DataFrame). All but the last give
back the columns of documents; rows that a stage rejects are gone, and the stage of
repeated passages gives back texts without them. run() writes every stage's result as
Parquet and rereads it.

Every stage takes null and empty texts, empty tables and columns of any other name; the
columns it doesn't name pass through. doc_id is a key: of rows that share one, a decision
about one of them holds for all. Rows without a doc_id can't be named as a copy, a passage
or a leak, so the stages that judge by doc_id keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm import bpe, decontaminate, minhash, quality, suffix
from echosieve.llm.common import Scratch, release

#: Bytes of a repeated passage, which nearly all runs of over 50 words have, and of the grams that anchor it.
PASSAGE, GRAM = 200, 64

#: The stages in SQL: none of them can be expressed.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is a half or more; null and empty texts are scored as
    texts without lines. With no labels to learn from every document is kept."""
    model = quality.train(quality.learnable(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies. Texts without
    words are copies of nothing and stay."""
    judged = minhash.near_duplicates(docs, width=5, percent=80, label="pipeline-minhash")
    return docs.join(judged.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that occur more than once, every place of them;
    n_chars, if there, follows. A text that is all repeats becomes empty; null stays null."""
    release(spark, "pipeline-minhash")
    _, changed = suffix.repeated_spans(docs, length=PASSAGE, gram=GRAM, label="pipeline-suffix")
    changed = changed.select(F.col("id").alias("__id"), F.struct(F.col("text").alias("text")).alias("__cut")).dropDuplicates(["__id"])
    out = docs.join(changed, docs["doc_id"] == changed["__id"], "left")
    new = {"text": F.when(F.col("__cut").isNull(), docs["text"]).otherwise(F.col("__cut.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__cut").isNull(), docs["n_chars"]).otherwise(F.length("__cut.text").cast(kind))
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found; null and empty texts stay."""
    release(spark, "pipeline-suffix")
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), label="pipeline-leaks")
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row left; null and empty
    texts have no tokens."""
    import public_tokenizers

    release(spark, "pipeline-leaks")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written as Parquet and reread."""
    scratch = Scratch(spark, "pipeline-run")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
