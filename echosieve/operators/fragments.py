"""Documents to paragraphs to fragments.

Documents are (doc_id, text). Lines are numbered from 1 in the body after the
frontmatter. Texts are cut into clauses where they lie; fragments are shuffled once, to be
numbered, and not at all by what needs no numbers (fragment_rows, tokens_by_document)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.config import Settings
from echosieve.functions import clauses as C
from echosieve.functions import text as T
from echosieve.functions.cli_tokens import cli_names


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, raw, stripped, start): start is the line's offset in the text."""
    front = F.length(T.frontmatter("text"))
    body = docs.where(F.col("text").isNotNull()).select("doc_id", front.alias("front"), F.posexplode(F.split(F.substring("text", front + 1, F.length("text")), "\n")).alias("i", "raw"))
    order = W.partitionBy("doc_id").orderBy("i")
    start = F.col("front") + F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return body.select("doc_id", (F.col("i") + 1).alias("line"), "raw", T.strip("raw").alias("stripped"), start.cast("int").alias("start"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_index, section, start_line, end_line, text, source, source_start):
    text has its lines stripped, source is the span of the document it stands for."""
    heading = F.col("stripped").rlike(rf"\A#{{1,6}}{T.WS}+")
    rows = lines(docs).withColumn("title", F.when(heading, T.strip(F.regexp_replace("stripped", rf"\A#{{1,6}}{T.WS}+", ""))))
    rows = rows.withColumn("is_break", heading | F.col("stripped").isin("---", ""))
    order = W.partitionBy("doc_id").orderBy("line")
    rows = rows.withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(order), F.lit("(preamble)")))
    rows = rows.withColumn("part", F.sum(F.col("is_break").cast("int")).over(order)).where("not is_break")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", rf"\A{T.WS}+", ""))
    parts = rows.withColumn("begin", F.col("start") + lead).groupBy("doc_id", "part").agg(
        F.first("section").alias("section"),
        F.min("line").alias("start_line"),
        F.max("line").alias("end_line"),
        F.array_sort(F.collect_list(F.struct("line", "stripped", "raw"))).alias("rows"),
        F.min_by("begin", "line").alias("source_start"),
    )
    joined = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "\n")
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("part")) - 1
    return parts.select("doc_id", number.alias("para_index"), "section", "start_line", "end_line", joined("stripped").alias("text"), T.strip(joined("raw")).alias("source"), "source_start")


def excluded_tokens(docs: DataFrame, dialect: str = "web") -> DataFrame:
    """(doc_id, excluded)."""
    return docs.select("doc_id", _excluded("text", dialect).alias("excluded"))


def _excluded(text, dialect: str) -> Column:
    """Names from the frontmatter and from speaker labels of the whole text."""
    if dialect == "cli":
        names = cli_names(F.concat(T.character_phrases(text), F.transform(T.speaker_phrases(text, "cli"), lambda p: F.regexp_replace(p, "[\"']", ""))))
    else:
        names = F.array_union(T.character_tokens(text), T.speaker_tokens(text))
    return F.coalesce(names, F.array().cast("array<string>"))


def clauses(docs: DataFrame, dialect: str = "web") -> DataFrame:
    """(doc_id, excluded, clauses) of every text."""
    # texts are dealt anew, by number: a file of few bytes, or of one row group, is much to cut
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("text", "doc_id").repartition(parts, "doc_id")
    rows = rows.select("text", "doc_id", _excluded("text", dialect).alias("excluded"))
    return rows.mapInArrow(C.cut, f"doc_id {kind}, excluded array<string>, clauses {C.SCHEMA}")


def _stays(text, next_char) -> Column:
    """Whether a cleaned clause is neither empty nor a label."""
    return (text != "") & ~(text.rlike(rf"\A{T.LABEL}\z") & F.coalesce(next_char == ":", F.lit(False)))


def _once(rows: DataFrame, name: str, value) -> DataFrame:
    """rows with a column worked out once: filters on it stay above the generator."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def fragment_rows(docs: DataFrame, settings: Settings = Settings(), tokens=None) -> DataFrame:
    """fragments() without numbers but (para_index, pos), not shuffled."""
    tokens = tokens or T.tokens
    rows = clauses(docs, settings.dialect).select("doc_id", "excluded", F.inline("clauses"))
    rows = _once(rows, "text", T.clean_fragment("piece")).where(_stays(F.col("text"), F.col("next_char")))
    rows = _once(rows, "tokens", tokens(F.col("text"), F.col("excluded"))).where(F.size("tokens") >= settings.min_tokens)
    edge = lambda pattern: F.regexp_replace("piece", pattern, "")
    lead = F.length("piece") - F.length(edge(rf"\A{T.EDGE}+"))
    trail = F.length("piece") - F.length(edge(rf"{T.EDGE}+\z"))
    source = {"source_start": F.col("start") + lead, "source_end": F.col("start") + F.length("piece") - trail}
    return rows.select("doc_id", "para_index", "pos", "section", "start_line", "text", *[v.alias(k) for k, v in source.items()], T.starts_capitalized("text").alias("starts_capitalized"), "tokens")


def fragments(docs: DataFrame, settings: Settings = Settings(), tokens=None) -> DataFrame:
    """(doc_id, idx, para_index, section, start_line, text, source_start, source_end,
    starts_capitalized, tokens), idx from 0 over the fragments of min_tokens tokens or
    more. `tokens` (text column, excluded column) -> array replaces the web tokenizer."""
    # by number: tokens are packed well, so few bytes are still much to sort
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fragment_rows(docs, settings, tokens).repartition(parts, "doc_id")
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("para_index", "pos")) - 1
    return rows.select("doc_id", idx.alias("idx"), "para_index", "section", "start_line", "text", "source_start", "source_end", "starts_capitalized", "tokens")


def tokens_by_document(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, tokens): the token lists of a document's fragments, inside its row."""
    rows = clauses(docs, settings.dialect)
    texts = F.transform("clauses", lambda c: F.struct(T.clean_fragment(c["piece"]).alias("text"), c["next_char"].alias("next_char")))
    lists = F.transform(F.filter(texts, lambda x: _stays(x["text"], x["next_char"])), lambda x: T.tokens(x["text"], F.col("excluded")))
    return rows.select("doc_id", F.filter(lists, lambda t: F.size(t) >= settings.min_tokens).alias("tokens"))
