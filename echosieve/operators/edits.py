"""Edits: removal spans, merging, rewriting, and the segments of a diff."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from echosieve.functions import text as T

BLANKS, DOUBLE = " \t", "\"“”"


def _back(at: str, chars: str):
    """Offset where the run of chars that ends at offset `at` begins."""
    return F.length(F.rtrim(F.left("text", F.col(at)), F.lit(chars)))


def _ahead(at: str, chars: str):
    """Offset where the run of chars that starts at offset `at` ends."""
    rest = F.substring("text", F.col(at) + 1, F.length("text"))
    return F.length("text") - F.length(F.ltrim(rest, F.lit(chars)))


def _one_of(char, chars: str):
    return (F.length(char) == 1) & F.contains(F.lit(chars), char)


def _at(offset):
    return F.when(offset >= 0, F.substring("text", offset + 1, F.lit(1))).otherwise("")


def removal_spans(rows: DataFrame) -> DataFrame:
    """rows(text, source_start, source_end, …) with left and right: the fragment widened
    over blanks, over one separator (a speaker's colon is none), blanks and quotes; a
    lone double quote is handed back. Steps are columns, so each is computed once."""
    rows = rows.withColumn("left", _back("source_start", BLANKS)).withColumn("right", _ahead("source_end", BLANKS))
    before, after = _at(F.col("left") - 1), _at(F.col("right"))
    label = T.strip(F.regexp_extract(F.left("text", F.col("left") - 1), r"[^\n]*\z", 0)).rlike(rf"\A{T.LABEL}\z")
    rows = rows.withColumn("_l", _one_of(before, T.SEPARATORS) & ~((before == ":") & label)).withColumn("_r", _one_of(after, T.SEPARATORS))
    rows = rows.withColumn("left", F.col("left") - F.col("_l").cast("int")).withColumn("right", F.col("right") + (F.col("_r") & ~F.col("_l")).cast("int"))
    for chars in (BLANKS, T.QUOTES):
        rows = rows.withColumn("left", _back("left", chars)).withColumn("right", _ahead("right", chars))
    gone = F.substring("text", F.col("left") + 1, F.col("right") - F.col("left"))
    rows = rows.withColumn("_gone", gone)
    lone = F.length("_gone") - F.length(F.translate("_gone", DOUBLE, "")) == 1
    give_left = lone & (F.col("left") < F.col("source_start")) & _one_of(F.left("_gone", F.lit(1)), DOUBLE)
    give_right = lone & ~give_left & (F.col("right") > F.col("source_end")) & _one_of(F.right("_gone", F.lit(1)), DOUBLE)
    rows = rows.withColumn("_gl", give_left).withColumn("_gr", give_right)
    rows = rows.withColumn("left", F.col("left") + F.col("_gl").cast("int")).withColumn("right", F.col("right") - F.col("_gr").cast("int"))
    rows = rows.withColumn("_la", F.least(_ahead("left", BLANKS), F.col("source_start"))).withColumn("_rb", F.greatest(_back("right", BLANKS), F.col("source_end")))
    rows = rows.withColumn("left", F.when(F.col("_gl"), F.col("_la")).otherwise(F.col("left"))).withColumn("right", F.when(F.col("_gr"), F.col("_rb")).otherwise(F.col("right")))
    return rows.drop("_l", "_r", "_gone", "_gl", "_gr", "_la", "_rb")


def searched(rows: DataFrame) -> DataFrame:
    """rows(text, fragment, …) with source_start and source_end at the fragment's first place
    in the text; rows whose fragment isn't there as it stands are left out."""
    rows = rows.withColumn("source_start", F.expr("locate(fragment, text) - 1")).where("source_start >= 0")
    return rows.withColumn("source_end", F.col("source_start") + F.length("fragment"))


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """removal_spans for one span of a Python text."""
    left, right = len(text[:start].rstrip(BLANKS)), len(text) - len(text[end:].lstrip(BLANKS))
    before, after = text[left - 1 : left] if left else "", text[right : right + 1]
    eat = before != "" and before in T.SEPARATORS
    if eat and before == ":" and re.fullmatch(T.LABEL, text[: left - 1].rpartition("\n")[2].strip(" \t\n\r\f\v")):
        eat = False
    left, right = left - eat, right + (not eat and after != "" and after in T.SEPARATORS)
    for chars in (BLANKS, T.QUOTES):
        left, right = len(text[:left].rstrip(chars)), len(text) - len(text[right:].lstrip(chars))
    gone = text[left:right]
    if sum(c in DOUBLE for c in gone) == 1:
        if left < start and gone[0] in DOUBLE:
            left = min(len(text) - len(text[left + 1 :].lstrip(BLANKS)), start)
        elif right > end and gone[-1] in DOUBLE:
            right = max(len(text[: right - 1].rstrip(BLANKS)), end)
    return left, right


@F.pandas_udf(StringType())
def _cut_in_order(text: pd.Series, fragments: pd.Series) -> pd.Series:
    def one(t: str, parts) -> str:
        for fragment in parts if parts is not None else ():
            at = t.find(fragment)
            if at >= 0:
                left, right = widened(t, at, at + len(fragment))
                t = t[:left] + " @ " + t[right:]
        return t

    return pd.Series([one(t, p) for t, p in zip(text, fragments)])


def apply_in_order(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text, rewritten): the fragments of rows(doc_id, para_index, idx, fragment) cut one
    after another from the last to the first, each at its first place in the text as it is then."""
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("para_index")).alias("p"), (-F.col("idx")).alias("i"), "fragment"))).alias("parts"))
    out = docs.select("doc_id", "text").where("text is not null").join(parts, "doc_id", "left")
    cut = F.when(F.col("parts").isNull(), F.col("text")).otherwise(_cut_in_order("text", F.transform("parts", lambda x: x["fragment"])))
    return out.withColumn("cut", cut).select("doc_id", "text", T.cleanup(T.edit_markers("cut")).alias("rewritten"))


def severity(rows: DataFrame, score: str = "score") -> DataFrame:
    """Adds severity: score from 0.22 to 1 within (doc_id, method); equal scores are 1."""
    w = W.partitionBy("doc_id", "method")
    low, high = F.min(score).over(w), F.max(score).over(w)
    raw = F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))
    return rows.withColumn("severity", F.round(raw * 0.78 + 0.22, 9))


def merged_spans(spans: DataFrame) -> DataFrame:
    """spans(doc_id, left, right, method, severity) with overlapping and touching ones
    merged; the method is that of the highest severity, of the first where equal."""
    local_first = F.when(F.col("method") == "local", 0).otherwise(1)
    order = [F.col("left"), F.col("right"), local_first, F.desc("severity")]
    w = W.partitionBy("doc_id").orderBy(*order)
    reach = F.max("right").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("place", F.row_number().over(w)).withColumn("new", (reach.isNull() | (F.col("left") > reach)).cast("int"))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    top = F.struct("severity", (-F.col("place")).alias("earlier"))
    return rows.groupBy("doc_id", "island").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.max_by("method", top).alias("method"), F.max("severity").alias("severity")).drop("island")


def span_lists(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): a document's merged spans in order."""
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("left", "right", "method", "severity"))).alias("spans"))


def segments(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, start, end, severity): the kept and removed parts of a text in
    order; kept parts have no severity, removed ones theirs within [.18, 1]."""
    rows = docs.select("doc_id", F.length("text").alias("n")).join(span_lists(spans), "doc_id", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<left:int,right:int,method:string,severity:double>>)")))
    cut = F.transform("spans", lambda s, i: F.array(F.struct(F.lit("keep").alias("kind"), F.coalesce(F.get("spans", i - 1)["right"], F.lit(0)).alias("start"), s["left"].alias("end"), F.lit(None).cast("double").alias("severity")), F.struct(s["method"].alias("kind"), s["left"].alias("start"), s["right"].alias("end"), F.greatest(F.lit(0.18), F.least(F.lit(1.0), s["severity"])).alias("severity"))))
    tail = F.array(F.struct(F.lit("keep").alias("kind"), F.coalesce(F.try_element_at("spans", F.lit(-1))["right"], F.lit(0)).alias("start"), F.col("n").alias("end"), F.lit(None).cast("double").alias("severity")))
    parts = F.filter(F.concat(F.flatten(cut), tail), lambda p: p["end"] > p["start"])
    return rows.select("doc_id", F.posexplode(parts).alias("seq", "p")).select("doc_id", "seq", "p.kind", "p.start", "p.end", "p.severity")


def apply_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, rewritten): every span becomes ' @ ', then markers and blanks are
    tidied. Documents without spans are tidied too."""
    rows = docs.select("doc_id", "text").join(span_lists(spans), "doc_id", "left")
    pieces = F.transform("spans", lambda s, i: F.substring("text", F.coalesce(F.get("spans", i - 1)["right"], F.lit(0)) + 1, s["left"] - F.coalesce(F.get("spans", i - 1)["right"], F.lit(0))))
    tail = F.expr("substring(text, try_element_at(spans, -1).right + 1, length(text))")
    cut = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.concat(pieces, F.array(tail)), " @ "))
    return rows.withColumn("cut", cut).select("doc_id", "text", T.cleanup(T.edit_markers("cut")).alias("rewritten"))


def document_metrics(applied: DataFrame, spans: DataFrame, frags: DataFrame, hot: DataFrame, dialect: str = "web") -> DataFrame:
    """One row per document: words, kept percentage, fragments, hotspots and removals."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").cast("long").alias(name))
    removed = spans.groupBy("doc_id").agg(F.count("*").cast("long").alias("removed_fragments"), F.count_if(F.col("method") == "local").cast("long").alias("local_removed"), F.count_if(F.col("method") == "scaffold").cast("long").alias("scaffold_removed"))
    rows = applied.select("doc_id", T.word_count("text", dialect).alias("original_words"), T.word_count("rewritten", dialect).alias("kept_words"))
    rows = rows.join(count(frags, "fragments"), "doc_id", "left").join(count(hot, "near_matched"), "doc_id", "left").join(removed, "doc_id", "left")
    rows = rows.fillna(0)
    rows = rows.withColumn("stripped_words", F.greatest(F.lit(0), F.col("original_words") - F.col("kept_words")))
    return rows.withColumn("kept_pct", F.round(F.col("kept_words") / F.greatest(F.lit(1), F.col("original_words")) * 100, 6))
