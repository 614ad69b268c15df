"""Registered queries over the driver tables, with DuckDB SQL for those it can express.

`documents` are texts of one paragraph; `conversations` become documents whose turns
are sections, so that paragraph distances count."""

from __future__ import annotations

import functools
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.config import Settings
from echosieve.functions import text as T
from echosieve.operators import diagnostics as D
from echosieve.operators import edits as E
from echosieve.operators import hotspots as H
from echosieve.operators import similarity as S
from echosieve.operators import templates as P
from echosieve.operators.fragments import fragment_rows, fragments, paragraphs, tokens_by_document
from echosieve.plans import oracle as O
from echosieve.plans.pipeline import analyze, batch, mine_models, split_models
from echosieve.sources import sinks

WEB = Settings()


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def talks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as markdown: a heading of the role and a paragraph per turn."""
    turn = F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("t"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("t", lambda x: x["t"]), "\n\n").alias("text"))


def chats(spark: SparkSession, d: str, many: int = 50) -> DataFrame:
    """So many conversations in a row as one paragraph, a line per turn."""
    rows = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.expr(f"conv_id div {many}").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t")))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda x: x["t"]), "\n").alias("text"))


def books(spark: SparkSession, d: str) -> DataFrame:
    """Eight conversations in a row as one document, long enough for distances to count."""
    turn = F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.expr("conv_id div 8").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", turn.alias("t")))).alias("t"))
    return rows.select("doc_id", F.array_join(F.transform("t", lambda x: x["t"]), "\n\n").alias("text"))


_held: list[DataFrame] = []
_written: list[tuple[SparkSession, str]] = []


def _kept(df: DataFrame, name: str = "") -> DataFrame:
    """Rows that several branches of one query read; spilled to disk, recomputed if lost, and
    given back when the next query is asked for."""
    _held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def _cut(df: DataFrame, name: str = "") -> DataFrame:
    """_kept() for queries of many jobs: the rows are made now, in a plan of one scan. A kept
    table's plan holds those of all tables below, and the driver keeps the text of every job's
    plan. Rows are written beneath spark.checkpoint.dir, or without one held by the executors."""
    spark = df.sparkSession
    base = spark.sparkContext.getCheckpointDir()
    if base is None:
        return df.localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK)
    path = f"{base}/echosieve-{name or 'table'}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back what earlier queries kept. Their results stay right, as plans are recomputed;
    those over tables that _cut() wrote must have been read."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as e:  # of a session that was stopped
            if spark.sparkContext._jsc is not None and "stopped" not in str(e).lower() and "connect" not in str(e).lower():
                raise
    while _held:
        try:
            _held.pop().unpersist()
        except Exception as e:  # of a session that was stopped: nothing is held there
            if "stopped" not in str(e).lower() and "connect" not in str(e).lower():
                raise


def _matchable(docs: DataFrame) -> DataFrame:
    """The fragments of docs, kept with what matching needs; tokens, which hold no blanks, as texts."""
    rows = fragments(docs).select("doc_id", "idx", "para_index", "starts_capitalized", F.array_join("tokens", " ").alias("tokens"))
    return _kept(rows).withColumn("tokens", F.split("tokens", " "))


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _ints(*cols):
    return ", ".join(f'"{c}"::BIGINT AS "{c}"' for c in cols)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name, sql=None):
    def put(f):
        @functools.wraps(f)
        def query(s, d):
            release()
            return f(s, d)

        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return f

    return put


@add("word_counts", f"SELECT doc_id, {O.words('text')}::BIGINT AS words FROM documents")
def word_counts(s, d):
    return documents(s, d).select("doc_id", T.word_count("text").alias("words"))


@add("sha256_docs", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_docs(s, d):
    return documents(s, d).select("doc_id", F.sha2("text", 256).alias("sha"))


_FLAT = O.strip(O.sub("text", O.WS + "+", " "))


@add("snippets", f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 80 THEN {_FLAT} ELSE {O.sub(f'left({_FLAT}, 79)', O.WS + '+' + chr(92) + 'z')} || '...' END AS snippet FROM documents")
def snippets(s, d):
    return documents(s, d).select("doc_id", T.snippet("text").alias("snippet"))


@add("cleanup_docs", f"SELECT doc_id, md5({O.cleanup('text')}) AS h FROM documents")
def cleanup_docs(s, d):
    return documents(s, d).select("doc_id", F.md5(T.cleanup("text").cast("binary")).alias("h"))


@add("edit_markers_docs", f"SELECT doc_id, md5({O.markers(O.sub('text', ' (the|de|der|la) ', ' @ '))}) AS h FROM documents")
def edit_markers_docs(s, d):
    return documents(s, d).select("doc_id", F.md5(T.edit_markers(F.regexp_replace("text", " (the|de|der|la) ", " @ ")).cast("binary")).alias("h"))


_PARA = f"SELECT doc_id, {_ints('para_index', 'start_line', 'end_line', 'source_start')}, section, md5(text) AS text FROM paragraphs"
for _n, _docs, _cte in (("paragraphs_documents", documents, O.DOCS), ("paragraphs_talks", talks, O.TALKS)):

    @add(_n, O.query(_cte, O.PARAGRAPHS, _PARA))
    def _paragraphs(s, d, docs=_docs):
        return _long(paragraphs(docs(s, d)), "para_index", "start_line", "end_line", "source_start").withColumn("text", F.md5(F.col("text").cast("binary"))).drop("source")


_FRAG = f"SELECT doc_id, {_ints('idx', 'para_index', 'source_start', 'source_end')}, section, text, starts_capitalized FROM fragments"
for _n, _docs, _cte in (("fragments", documents, O.DOCS), ("fragments_talks", talks, O.TALKS)):

    @add(_n, O.query(_cte, O.FRAGMENTS, _FRAG))
    def _fragments(s, d, docs=_docs):
        return _long(fragments(docs(s, d)), "idx", "para_index", "source_start", "source_end").drop("tokens", "start_line")


@add("tokens", O.query(O.DOCS, O.FRAGMENTS, f"SELECT doc_id, {_ints('idx')}, len(tokens)::BIGINT AS n, array_to_string(tokens, ' ') AS tokens FROM fragments"))
def tokens(s, d):
    return fragments(documents(s, d)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@add("speaker_tokens", O.query(O.TALKS, O.LINES, f"SELECT doc_id, array_to_string(list_sort({O.names(O.SPEAKERS)}), ' ') AS names FROM front"))
def speaker_tokens(s, d):
    return talks(s, d).select("doc_id", F.array_join(F.array_sort(T.speaker_tokens("text")), " ").alias("names"))


@add("ngram_counts", O.query(O.DOCS, O.FRAGMENTS, f"SELECT ngram, count(*) AS n FROM (SELECT unnest({O.grams('tokens', 3)}) AS ngram FROM fragments) GROUP BY ngram"))
def ngram_counts(s, d):
    return D.ngram_counts(fragment_rows(documents(s, d)))


@add("phrase_counts_topk", O.query(O.TALKS, O.HOT, f"SELECT phrase, count(*) AS n FROM (SELECT unnest({O.PHRASES}) AS phrase FROM hot) GROUP BY phrase HAVING count(*) >= 4 ORDER BY n DESC, phrase LIMIT 40"))
def phrase_counts_topk(s, d):
    return D.repeated_phrases(H.hotspots(_kept(fragments(talks(s, d)))))


@add("phrase_counts_cli", O.query(O.TALKS, O.HOT, f"SELECT * FROM (SELECT phrase, count(*) AS n FROM (SELECT unnest(list_distinct({O.PHRASES})) AS phrase FROM hot) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 30) WHERE n >= 4"))
def phrase_counts_cli(s, d):
    return D.repeated_phrases(H.hotspots(_kept(fragments(talks(s, d)))), "cli")


_FLAG = "SELECT doc_id, {i}, array_to_string(signatures, '|') AS signatures, array_to_string(reasons, '|') AS reasons, round(dominant_share, 9) AS dominant_share, round(unique_ratio, 9) AS unique_ratio, round(repeat_density, 9) AS repeat_density, round(score, 6) AS score FROM flags".format(i=_ints("idx", "repeated_windows", "repeated_mass"))


@add("fragment_flags", O.query(O.DOCS, O.FLAGS, _FLAG))
def fragment_flags(s, d):
    rows = _long(D.pattern_flags(fragments(documents(s, d))), "idx", "repeated_windows", "repeated_mass")
    nine = [F.round(c, 9).alias(c) for c in ("dominant_share", "unique_ratio", "repeat_density")]
    return rows.select("doc_id", "idx", "repeated_windows", "repeated_mass", F.array_join("signatures", "|").alias("signatures"), F.array_join("reasons", "|").alias("reasons"), *nine, F.round("score", 6).alias("score"))


@add("reason_counts", O.query(O.DOCS, O.FLAGS, "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM flags) GROUP BY reason"))
def reason_counts(s, d):
    return D.reason_counts(D.pattern_flags(fragments(documents(s, d))))


@add("window_counts", O.query(O.DOCS, O.FLAGS, "SELECT phrase, count(*) AS n FROM (SELECT unnest(signatures) AS phrase FROM flags) GROUP BY phrase"))
def window_counts(s, d):
    return D.window_counts(D.pattern_flags(fragments(documents(s, d))))


@add("token_postings", O.query(O.DOCS, O.pairs(12), "SELECT doc_id, token, n FROM postings"))
def token_postings(s, d):
    return S.postings_in_rows(tokens_by_document(documents(s, d)))


for _n, _docs, _cte, _r in (("candidate_pairs", documents, O.DOCS, 12), ("candidate_pairs_near", talks, O.TALKS, 1), ("candidate_pairs_talks", talks, O.TALKS, 2)):

    @add(_n, O.query(_cte, O.pairs(_r), f"SELECT doc_id, {_ints('a', 'b', 'distance')} FROM pairs"))
    def _pairs(s, d, docs=_docs, r=_r):
        return _long(S.candidate_pairs(_matchable(docs(s, d)), WEB, r), "a", "b", "distance")


_SIM = [f"round({c}, 9) AS {c}" for c in ("overlap", "seq", "bigram", "trigram", "size", "score")]


@add("pair_similarity", O.query(O.TALKS, O.similar(12), f"SELECT doc_id, {_ints('a', 'b', 'shared')}, {', '.join(_SIM)}, exchange FROM scored"))
def pair_similarity(s, d):
    rows = S.scored_pairs(_matchable(talks(s, d)), WEB)
    return _long(rows, "a", "b", "shared").select("doc_id", "a", "b", "shared", *[F.round(c, 9).alias(c) for c in ("overlap", "seq", "bigram", "trigram", "size", "score")], "exchange")


@add("matches", O.query(O.TALKS, O.base_matched(), f"SELECT doc_id, {_ints('idx', 'other', 'distance', 'shared')}, round(score, 9) AS score, round(weighted, 9) AS weighted FROM matches"))
def matches(s, d):
    rows = _long(S.matches(_matchable(talks(s, d)), common=False), "idx", "other", "distance", "shared")
    return rows.select("doc_id", "idx", "other", "distance", "shared", F.round("score", 9).alias("score"), F.round("weighted", 9).alias("weighted"))


_HOT = f"SELECT doc_id, {_ints('idx', 'match_count', 'reusable', 'unique')}, round(density, 6) AS density, round(badness, 6) AS badness, round(reusable_ratio, 9) AS reusable_ratio, hint FROM hot"


def _hotspots(s, d, docs, rounds=None):
    rows = _long(H.hotspots(_matchable(docs(s, d)), WEB, rounds), "idx", "match_count", "reusable", "unique")
    return rows.select("doc_id", "idx", "match_count", "reusable", "unique", F.round("density", 6).alias("density"), F.round("badness", 6).alias("badness"), F.round("reusable_ratio", 9).alias("reusable_ratio"), "hint")


@add("hotspots", O.query(O.TALKS, O.HOT, _HOT))
def hotspots(s, d):
    return _hotspots(s, d, talks)


@add("hotspots_documents", O.query(O.DOCS, O.hot(O.base_matched()), _HOT))
def hotspots_documents(s, d):
    """Documents are one paragraph, and the base radius alone is asked for."""
    return _hotspots(s, d, documents, 0)


@add("hotspots_frontier", O.query(O.BOOKS, O.HOT, _HOT))
def hotspots_frontier(s, d):
    return _hotspots(s, d, books)


@add("frontier_matches", O.query(O.BOOKS, O.matched(), f"SELECT doc_id, {_ints('idx', 'other', 'distance', 'shared')}, round(score, 9) AS score, round(weighted, 9) AS weighted FROM matches"))
def frontier_matches(s, d):
    rows = _long(H.frontier_matches(_kept(fragments(books(s, d))), WEB), "idx", "other", "distance", "shared")
    return rows.select("doc_id", "idx", "other", "distance", "shared", F.round("score", 9).alias("score"), F.round("weighted", 9).alias("weighted"))


@add("keep_hints", O.query(O.TALKS, O.HOT, "SELECT hint, count(*) AS n FROM hot GROUP BY hint"))
def keep_hints(s, d):
    return H.hotspots(_kept(fragments(talks(s, d)))).groupBy("hint").agg(F.count("*").alias("n"))


for _p in ("low", "med", "high"):

    @add(f"profile_selection_{_p}", O.query(O.TALKS, O.selection(_p), f"SELECT doc_id, {_ints('idx', 'rank', 'pick')} FROM selected"))
    def _selection(s, d, p=_p):
        frags = _kept(fragments(talks(s, d)))
        return _long(H.selected_rows(H.hotspots(frags), frags, p), "idx", "rank", "pick").select("doc_id", "idx", "rank", "pick")


@add("wildcard_masks", O.query(O.TALKS, f"{O.FRAGMENTS},\n{O.MASKS.strip()}", f"SELECT length, mask, {_ints('windows')} FROM (SELECT length, mask, sum(len(tokens) - length + 1) AS windows FROM masks JOIN fragments ON len(tokens) >= length GROUP BY ALL)"))
def wildcard_masks(s, d):
    n = F.size("tokens")
    windows = fragments(talks(s, d)).where(n >= min(P.LENGTHS)).select(n.alias("n"), F.explode(F.sequence(F.lit(min(P.LENGTHS)), F.least(n, F.lit(max(P.LENGTHS))))).alias("length"))
    windows = windows.groupBy("length").agg(F.sum(F.col("n") - F.col("length") + 1).alias("windows"))
    return P.wildcard_masks(s).join(windows, "length").select("length", "mask", "windows")


def _counts(s, d, docs=talks):
    frags = _cut(fragments(docs(s, d)), "fragments")
    occ = P.occurrences(frags, [], table=_cut)
    return frags, occ, _cut(P.template_counts(occ, []), "counts")


@add("template_counts", O.query(O.TALKS, O.TEMPLATES, f"SELECT array_to_string(template, ' ') AS template, {_ints('count', 'sections', 'slot_variety', 'slots')} FROM templates"))
def template_counts(s, d):
    return _long(_counts(s, d)[2].withColumn("template", F.array_join("template", " ")), "count", "sections", "slot_variety", "slots")


@add("template_ranked", O.query(O.TALKS, O.TEMPLATES, f"SELECT text, {_ints('rank', 'count', 'slot_variety')}, score FROM ranked"))
def template_ranked(s, d):
    return _long(P.ranked_templates(_counts(s, d)[2], []), "rank", "count", "slot_variety").select("text", "rank", "count", "slot_variety", "score")


@add("hot_tokens", O.query(O.TALKS, O.TEMPLATES, "SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(template, lambda t: t <> '_')) AS token FROM (SELECT template FROM solid GROUP BY template HAVING count(*) >= 2)) GROUP BY token HAVING count(*) >= 2"))
def hot_tokens(s, d):
    occ = P.occurrences(_kept(fragments(talks(s, d))), [], 2, _kept)
    counts = occ.groupBy(F.array_join("template", " ").alias("text")).agg(F.count("*").alias("count")).where("count >= 2")
    return P.hot_tokens(counts.select(F.split("text", " ").alias("template")), [])


@add("templates_dedup", O.query(O.TALKS, O.CHOSEN, f"SELECT {_ints('model_rank', 'rank', 'count')}, text, score FROM chosen"))
def templates_dedup(s, d):
    _, occ, counts = _counts(s, d)
    return _long(P.dedup_templates(_cut(P.ranked_templates(counts, []), "ranked"), occ, []), "model_rank", "rank", "count").select("model_rank", "rank", "count", "text", "score")


@add("template_counts_by_document")
def template_counts_by_document(s, d):
    scope = ["doc_id"]
    return P.template_counts(P.occurrences(_kept(fragments(documents(s, d))), scope, table=_kept), scope)


def _models(s, d, docs=talks):
    """Probabilities of the templates that are chosen."""
    frags = _cut(fragments(docs(s, d)), "fragments")
    return frags, _cut(mine_models(frags, [], _cut), "models")


@add("pattern_model_probs", O.query(O.TALKS, O.MODELS, f"SELECT {_ints('model_rank', 'pos', 'n')}, token, round(prob, 9) AS prob FROM probs"))
def pattern_model_probs(s, d):
    return _long(_models(s, d)[1], "model_rank", "pos", "n").select("model_rank", "pos", "n", "token", F.round("prob", 9).alias("prob"))


_CAND = f"SELECT doc_id, {_ints('model_rank', 'idx', 'para_index', 'start', 'matched')}, round(score, 6) AS score, round(peak, 9) AS peak FROM "


def _cands(df):
    return _long(df, "model_rank", "idx", "para_index", "start", "matched").select("doc_id", "model_rank", "idx", "para_index", "start", "matched", F.round("score", 6).alias("score"), F.round("peak", 9).alias("peak"))


@add("pattern_candidates", O.query(O.TALKS, O.CANDIDATES, _CAND + "cands"))
def pattern_candidates(s, d):
    return _cands(P.pattern_candidates(*_models(s, d), []))


for _p in ("keep-1", "keep-2", "threshold-dedup"):

    @add(f"policy_{_p.replace('-', '_')}", O.query(O.CHATS, O.policy(_p), _CAND + "picked"))
    def _policy(s, d, p=_p):
        return _cands(P.select_candidates(P.pattern_candidates(*_models(s, d, chats), []), p))


@add("cascade_selection", O.query(O.CHATS, O.policy("keep-1"), "SELECT doc_id, idx::BIGINT AS idx, min(model_rank)::BIGINT AS model_rank FROM picked GROUP BY doc_id, idx"))
def cascade_selection(s, d):
    rows = P.cascade(P.select_candidates(P.pattern_candidates(*_models(s, d, chats), []), "keep-1"))
    return _long(rows, "idx", "model_rank").select("doc_id", "idx", "model_rank")


def _local(s, d):
    docs = _kept(talks(s, d))
    frags = _kept(fragments(docs))
    hot = _kept(H.hotspots(frags))
    rows = H.selected_rows(hot, frags).join(frags.select("doc_id", "idx", "source_start", "source_end"), ["doc_id", "idx"])
    return docs, frags, hot, E.removal_spans(rows.join(docs, "doc_id"))


def _merged(s, d):
    docs, frags, hot, spans = _local(s, d)
    graded = E.severity(spans.withColumn("method", F.lit("local")), "badness")
    return docs, frags, hot, _kept(E.merged_spans(graded.select("doc_id", "left", "right", "method", "severity")))


@add("removal_spans", O.query(O.TALKS, O.SPANS, f"SELECT doc_id, {_ints('idx', 'left', 'right')} FROM spans"))
def removal_spans(s, d):
    return _long(_local(s, d)[3], "idx", "left", "right").select("doc_id", "idx", "left", "right")


@add("merged_spans", O.query(O.TALKS, O.MERGED, f"SELECT doc_id, {_ints('left', 'right')}, method, round(severity, 6) AS severity FROM merged"))
def merged_spans(s, d):
    return _long(_merged(s, d)[3], "left", "right").select("doc_id", "left", "right", "method", F.round("severity", 6).alias("severity"))


@add("applied_text", O.query(O.TALKS, O.APPLIED, "SELECT doc_id, rewritten FROM applied"))
def applied_text(s, d):
    docs, _, _, spans = _merged(s, d)
    return E.apply_spans(docs, spans).select("doc_id", "rewritten")


@add(
    "diff_segments",
    O.query(
        O.TALKS,
        O.MERGED,
        """SELECT * FROM (SELECT doc_id, 'keep' AS kind, prev AS start, "left"::BIGINT AS "end", NULL::DOUBLE AS severity FROM (SELECT *, coalesce(lag("right") OVER (PARTITION BY doc_id ORDER BY "left"), 0)::BIGINT AS prev FROM merged)
UNION ALL SELECT doc_id, method, "left"::BIGINT, "right"::BIGINT, round(greatest(0.18e0, least(1.0e0, severity)), 6) FROM merged
UNION ALL SELECT d.doc_id, 'keep', coalesce(m.r, 0)::BIGINT, length(d.text), NULL FROM docs d LEFT JOIN (SELECT doc_id, max("right") AS r FROM merged GROUP BY 1) m ON m.doc_id = d.doc_id) WHERE "end" > start""",
    ),
)
def diff_segments(s, d):
    docs, _, _, spans = _merged(s, d)
    return _long(E.segments(docs, spans), "start", "end").select("doc_id", "kind", "start", "end", F.round("severity", 6).alias("severity"))


_MET = ("original_words", "kept_words", "fragments", "near_matched", "removed_fragments", "local_removed", "scaffold_removed", "stripped_words")


def _metrics(s, d):
    docs, frags, hot, spans = _merged(s, d)
    return _long(E.document_metrics(E.apply_spans(docs, spans), spans, frags, hot), *_MET)


@add("doc_metrics", O.query(O.TALKS, O.METRICS, f"SELECT doc_id, {_ints(*_MET)}, kept_pct FROM doc_metrics"))
def doc_metrics(s, d):
    return _metrics(s, d).select("doc_id", *_MET, "kept_pct")


@add("batch_totals", O.query(O.TALKS, O.METRICS, "SELECT count(*) AS files, sum(original_words)::BIGINT AS original_words, sum(kept_words)::BIGINT AS kept_words, sum(stripped_words)::BIGINT AS stripped_words, sum(removed_fragments)::BIGINT AS removed, round(sum(kept_words) / greatest(1, sum(original_words))::DOUBLE * 100, 6) AS kept_pct FROM doc_metrics"))
def batch_totals(s, d):
    return sinks.batch_totals(_metrics(s, d))


@add("removal_method_counts", O.query(O.TALKS, O.MERGED, "SELECT method, count(*) AS n FROM merged GROUP BY method"))
def removal_method_counts(s, d):
    return _merged(s, d)[3].groupBy("method").agg(F.count("*").alias("n"))


@add("profile_output_names", "SELECT doc_id, 'doc-' || doc_id || '.med.light.md' AS name FROM documents")
def profile_output_names(s, d):
    return documents(s, d).select("doc_id", sinks.export_name(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")), "med", "light").alias("name"))


@add("batch_jobs", "SELECT doc_id, sha256(text) AS hash, length(text)::BIGINT AS size, 'queued' AS status FROM documents")
def batch_jobs(s, d):
    return sinks.batch_jobs(documents(s, d).withColumn("name", F.col("doc_id").cast("string"))).select("doc_id", "hash", "size", "status")


@add("top_matches", O.query(O.TALKS, O.matched(), f"SELECT * FROM (SELECT doc_id, {_ints('idx', 'other', 'distance')}, row_number() OVER (PARTITION BY doc_id, idx ORDER BY weighted DESC, distance, other) AS place FROM matches) WHERE place <= 5"))
def top_matches(s, d):
    rows = H.top_matches(H.frontier_matches(_kept(fragments(talks(s, d))), WEB))
    return _long(rows, "idx", "other", "distance", "place").select("doc_id", "idx", "other", "distance", "place")


@add("top_hotspots", O.query(O.TALKS, O.HOT, f"SELECT * FROM (SELECT doc_id, {_ints('idx', 'match_count')}, row_number() OVER (PARTITION BY doc_id ORDER BY badness DESC, match_count DESC, idx DESC) AS place FROM hot) WHERE place <= 40"))
def top_hotspots(s, d):
    rows = H.top_hotspots(H.hotspots(_kept(fragments(talks(s, d)))))
    return _long(rows, "idx", "match_count", "place").select("doc_id", "idx", "match_count", "place")


@add("top_flags", O.query(O.DOCS, O.FLAGS, f"SELECT * FROM (SELECT doc_id, {_ints('idx')}, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, round(repeat_density, 9) DESC, idx) AS place FROM flags) WHERE place <= 20"))
def top_flags(s, d):
    return _long(D.top_flags(D.pattern_flags(fragments(documents(s, d))), 20), "idx", "place").select("doc_id", "idx", "place")


@add("top_template_tokens", O.query(O.TALKS, O.MODELS, f"SELECT * FROM (SELECT {_ints('model_rank', 'pos', 'n')}, token, row_number() OVER (PARTITION BY model_rank, pos ORDER BY n DESC, token) AS place FROM probs) WHERE place <= 5"))
def top_template_tokens(s, d):
    return _long(P.top_tokens(_models(s, d)[1], []), "model_rank", "pos", "n", "place").select("model_rank", "pos", "n", "token", "place")


@add(
    "soft_templates",
    O.query(
        O.TALKS,
        O.MODELS,
        """SELECT model_rank::BIGINT AS model_rank, string_agg(cell, ' ' ORDER BY pos) AS soft_text FROM (
SELECT model_rank, pos, CASE WHEN max(prob) >= 0.84e0 THEN arg_min(token, place) ELSE '{' || array_to_string(list(token ORDER BY place) FILTER (place <= 3), '/') || '}' END AS cell
FROM (SELECT *, row_number() OVER (PARTITION BY model_rank, pos ORDER BY n DESC, token) AS place FROM probs) GROUP BY model_rank, pos) GROUP BY model_rank""",
    ),
)
def soft_templates(s, d):
    return _long(P.soft_text(_models(s, d)[1], []), "model_rank").select("model_rank", "soft_text")


@add("bakeoff_candidates_topk", O.query(O.CHATS, O.CANDIDATES, f"SELECT doc_id, {_ints('idx', 'start', 'matched')}, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS place FROM cands WHERE model_rank = 1) WHERE place <= 20"))
def bakeoff_candidates_topk(s, d):
    frags, probs = _models(s, d, chats)
    rows = P.top_candidates(P.pattern_candidates(frags, probs.where("model_rank = 1"), []))
    return _long(rows, "idx", "start", "matched", "place").select("doc_id", "idx", "start", "matched", F.round("score", 6).alias("score"), "place")


_THEN = "2020-01-01T00:00:00.000Z"


@add(
    "result_frontmatter",
    O.query(
        O.TALKS,
        O.METRICS,
        f"""SELECT doc_id, md5('---' || chr(10) || 'echosieve: {{"tool":"echosieve.v1","mode":"repetition removal","file":"' || doc_id || '","input_sha256":"' || sha256(text) || '","processed_at":"{_THEN}","local_pass":"med","scaffold_pass":"off","settings":"' || replace('{Settings(scaffold="off").to_json()}', '"', chr(92) || '"') || '","words":{{"original":' || original_words || ',"kept":' || kept_words || ',"stripped":' || stripped_words || '}},"removals":{{"local":' || local_removed || ',"scaffold":0,"total":' || removed_fragments || '}}}}' || chr(10) || '---' || chr(10) || chr(10) || rewritten) AS h FROM doc_metrics JOIN applied USING (doc_id)""",
    ),
)
def result_frontmatter(s, d):
    settings = Settings(scaffold="off")
    docs = _kept(talks(s, d))
    return sinks.with_frontmatter(analyze(docs, settings, table=_kept), docs, settings, _THEN).select("doc_id", F.md5(F.col("output").cast("binary")).alias("h"))


@add("job_updates", "SELECT doc_id::VARCHAR AS id, sha256(text) AS hash, CASE WHEN doc_id % 3 = 0 THEN 'complete' ELSE 'queued' END AS status, CASE WHEN doc_id % 3 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS progress FROM documents")
def job_updates(s, d):
    jobs = sinks.batch_jobs(documents(s, d).withColumn("name", F.col("doc_id").cast("string"))).withColumn("id", F.col("name"))
    done = documents(s, d).where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("complete").alias("status"), F.lit(100.0).alias("progress"))
    strangers = done.limit(1).withColumn("id", F.lit("none of them"))
    return sinks.update_jobs(jobs, done.union(strangers)).select("id", "hash", "status", "progress")


@add("cli_words_documents")
def cli_words_documents(s, d):
    from echosieve.functions.cli_tokens import cli_word_count

    return documents(s, d).select("doc_id", cli_word_count(F.col("text")).alias("n"))


@add("refloors_by_profile")
def refloors_by_profile(s, d):
    frags = _kept(fragments(talks(s, d)))
    return sinks.refloors(talks(s, d), frags, _kept(H.hotspots(frags)), ["low", "med", "high"]).drop("rewritten")


@add("analyze_own_models")
def analyze_own_models(s, d):
    return analyze(_kept(talks(s, d)), table=_kept).metrics


def _batched(s, d, scaffold):
    done = batch(_cut(chats(s, d, 3), "notes"), Settings(scaffold=scaffold), table=_cut).metrics
    return _long(done, *_MET).select("doc_id", *_MET, "kept_pct")


for _p, _mode in (("threshold-dedup", "light"), ("keep-2", "medium"), ("keep-1", "hard")):

    @add("batch_shared_models" if _mode == "light" else f"batch_shared_models_{_mode}", O.query(O.NOTES, O.batch(_p), f"SELECT doc_id, {_ints(*_MET)}, kept_pct FROM doc_metrics"))
    def _batch(s, d, mode=_mode):
        return _batched(s, d, mode)


@add("batch_split_models")
def batch_split_models(s, d):
    return split_models(_cut(fragments(talks(s, d)), "fragments"), 3, crossover=True, table=_cut)


@add("bakeoff")
def bakeoff(s, d):
    return sinks.bakeoff(_cut(talks(s, d), "talks"), WEB, _cut)


@add("cli_hotspots")
def cli_hotspots(s, d):
    from echosieve.config import CLI
    from echosieve.plans.pipeline import fragment_rows

    rows = H.hotspots(fragment_rows(talks(s, d), CLI), CLI)
    return rows.select("doc_id", "idx", "match_count", F.round("badness", 6).alias("badness"), "hint")
