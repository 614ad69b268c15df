"""WARC archives: writing, and reading by boundary-chain verification.

Writing. Records are rows of the text writer, whose line ends are the last byte of
every record, so Spark's own committers put the archives wherever it can write. An
archive is closed after a bounded number of records and is gzipped as a whole.

Reading. An archive is searched in chunks for the magic line. Every hit is only a
candidate: its header gives the offset of its successor. Chains are followed inside
a chunk first; what leaves a chunk is followed by pointer jumping over written
tables from the start of the file. Only records on the chain from offset 0 are real;
magic lines inside payloads are not reached."""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, iter_groups, one_row_per_id, tidy

RECORDS_PER_FILE, CHUNK = 1000, 1 << 20
DATE = "2020-01-01T00:00:00Z"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)


def record_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages(id, html) with digest (SHA-1 of the UTF-8 payload), size and refers_to:
    of equal payloads of at least `least` bytes the largest id is the response."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha1(body)).withColumn("size", F.length(body).cast("long"))
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, ["digest", "size"], "left")
    return rows.withColumn("refers_to", F.when(F.col("keeper") != F.col("id"), F.col("keeper"))).drop("keeper")


def _urn(column) -> F.Column:
    h = F.sha1(F.concat(F.lit("echosieve/"), column.cast("string")))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _line(name: str, value) -> F.Column:
    """A header line; line ends in values become blanks."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\r\n"))


def write_archives(rows: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per row of record_types' result with a url column. A revisit has
    no payload; its digest names its response's. Null payloads are empty."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit(f"WARC-Date: {DATE}\r\nContent-Type: application/octet-stream\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("size")),
        _line("X-Page-ID", F.col("id")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", _urn(F.col("refers_to"))), _line("X-Refers-To-Page", F.col("refers_to")))).otherwise(F.lit("")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, payload, F.lit("\r\n\r"))  # the writer adds the last line end
    rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


_FIELDS = (b"x-page-id", b"warc-type", b"warc-target-uri", b"warc-payload-digest", b"x-payload-length", b"x-refers-to-page")


def _headers(data: bytes, first: int, last: int) -> list[tuple[int, dict[str, str], int, int]]:
    """(offset, fields, start of the block, successor) of every candidate from first to before
    last that has a whole header. Candidates may share a blank line, when magic stands inside
    a header; it is looked for once, and each line is parsed once, from the last candidate back."""
    spots = [(m.start(), m.end()) for m in _MAGIC.finditer(data, first, min(len(data), last + 9)) if m.start() < last]
    ends, end = [], -2
    for at, _ in spots:
        if end != -1 and end < at:
            end = data.find(b"\r\n\r\n", at)
        ends.append(end)
    out, fields, length, below = [], {}, None, -1
    for k in range(len(spots) - 1, -1, -1):
        (at, lines), end = spots[k], ends[k]
        if end < 0:
            continue
        if end != below:
            fields, length, below, stop = {}, None, end, end + 2
        own = {}
        for line in data[lines:stop].split(b"\r\n"):
            name, colon, value = line.partition(b":")
            if colon and name.strip().lower() in _FIELDS:
                own[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        m = _LENGTH.search(data, lines - 2, stop)
        fields, length, stop = own | fields, int(m[1]) if m else length, lines
        if length is not None:
            out.append((at, fields, end + 4, end + 4 + length + 4))
    return out[::-1]


def _candidates(chunk: int):
    """Every candidate of a file: its offset, where its chain leaves its chunk, and
    what its record says. `next` is -1 where the successor doesn't follow two line ends."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.column(1)[row].as_buffer()
                data = gzip.decompress(raw) if raw[:2].to_pybytes() == b"\x1f\x8b" else raw.to_pybytes()
                name = batch.column(0)[row].as_py()
                for first in range(0, max(1, len(data)), chunk):
                    offs, nexts, recs = [], [], []
                    for at, fields, start, after in _headers(data, first, first + chunk):
                        sound = after <= len(data) and data[after - 4 : after] == b"\r\n\r\n"
                        offs.append(at)
                        nexts.append(after if sound else -1)
                        body = data[start : after - 4] if sound else b""
                        recs.append((fields.get("x-page-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields.get("x-payload-length"), fields.get("x-refers-to-page"), len(body), hashlib.sha1(body).hexdigest()))
                    if not offs:
                        continue
                    # inside the chunk: jump until every pointer has left it
                    offs_a, exits = np.array(offs, np.int64), np.array(nexts, np.int64)
                    while True:
                        k = np.searchsorted(offs_a, exits)
                        inner = (exits >= 0) & (exits < first + chunk) & (k < len(offs_a))
                        inner[inner] = offs_a[k[inner]] == exits[inner]
                        if not inner.any():
                            break
                        exits = np.where(inner, exits[np.where(inner, k, 0)], exits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(offs)),
                            pa.array([first // chunk] * len(offs), pa.int64()),
                            pa.array(offs, pa.int64()),
                            pa.array(nexts, pa.int64()),
                            pa.array(exits),
                            pa.array([int(r[0]) if r[0] and r[0].lstrip("-").isdigit() else None for r in recs], pa.int64()),
                            *[pa.array([r[j] for r in recs], pa.string()) for j in (1, 2, 3)],
                            *[pa.array([int(r[j]) if r[j] and r[j].lstrip("-").isdigit() else None for r in recs], pa.int64()) for j in (4, 5)],
                            pa.array([r[6] for r in recs], pa.int64()),
                            pa.array([r[7] for r in recs]),
                        ],
                        names=_NAMES,
                    )

    return run


_NAMES = ["file", "chunk", "at", "next", "exit", "page", "type", "url", "digest", "full_size", "refers_to", "size", "body_digest"]
_SCHEMA = "file string, chunk long, at long, next long, exit long, page long, type string, url string, digest string, full_size long, refers_to long, size long, body_digest string"


def read_archives(spark: SparkSession, path: str, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """The true records of all archives under path (plain or gzipped as a whole):
    (file, at, page, type, url, digest, full_size, refers_to, size, body_digest)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = scratch.save(files.mapInArrow(tidy(_candidates(chunk)), _SCHEMA), "candidates")
    # pointer jumping over the places where chains enter chunks: reached doubles its
    # steps each round, from the file's start
    jump = found.select("file", F.col("at"), F.col("exit").alias("to")).where("to > at")
    reached = scratch.save(found.where("at = 0").select("file", "at"), "reached")
    while True:
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        wider = scratch.save(reached.union(step).distinct(), "reached")
        grown = wider.count() > reached.count()
        scratch.drop(reached)
        reached = wider
        if not grown:
            break
        far = jump.alias("x").join(jump.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.to") == F.col("y.at"))).select("x.file", "x.at", "y.to")
        jump = scratch.save(far, "jump")
    # entries of the chunks; inside a chunk the chain is followed at once
    entries = reached.select("file", F.col("at").alias("entry"), F.floor(F.col("at") / chunk).cast("long").alias("chunk")).groupBy("file", "chunk").agg(F.min("entry").alias("entry"))
    rows = found.join(entries, ["file", "chunk"])

    def follow(batches):
        for group in iter_groups(batches, ["file", "chunk"]):
            at, nxt = group.column("at").to_numpy(), group.column("next").to_numpy()
            where = {a: k for k, a in enumerate(at.tolist())}
            keep, here = [], group.column("entry")[0].as_py()
            while here in where and nxt[where[here]] > here:
                keep.append(where[here])
                here = int(nxt[where[here]])
            if keep:
                yield from group.select(_NAMES).take(pa.array(keep)).combine_chunks().to_batches()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chains = rows.repartition(n, "file", "chunk").sortWithinPartitions("file", "chunk").mapInArrow(tidy(follow), _SCHEMA)
    return chains.drop("chunk", "next", "exit")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", label: str = "warc", least: int = 1000) -> DataFrame:
    """Write a record per row, read the archives back and return what they say:
    (id_col, payload_bytes, payload_digest, record_type, refers_to).

    Payloads are html in UTF-8 (null: empty). Of equal payloads of at least `least`
    bytes the largest id is the response, the others revisit it; smaller ones are all
    responses. A response's size and digest come from the payload that was read; a
    revisit's from the response it refers to. Of rows that repeat an id the one with the
    least url and html counts, rows without an id are left out; other columns are ignored.
    A record that was written and isn't on its archive's chain is an error."""
    spark = pages.sparkSession
    scratch = Scratch(spark, label)
    rows = one_row_per_id(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")))
    path = scratch.path("archives")
    write_archives(record_types(rows, least), path)
    records = scratch.save(read_archives(spark, path, scratch), "records")
    written, reached = rows.count(), records.count()
    if written != reached:
        raise RuntimeError(f"{written} records were written, but {reached} are on the archives' chains")
    responses = records.where("type = 'response'").select(F.col("page").alias("keeper"), F.col("size").alias("keeper_size"), F.col("body_digest").alias("keeper_digest"))
    wanted = records.where("type = 'revisit'").select("page", F.col("refers_to").alias("keeper"))
    # a response many pages revisit is one row; the join's many rows are the revisits
    revisits = wanted.join(responses, "keeper").select(F.col("page").alias(id_col), F.col("keeper_size").alias("payload_bytes"), F.col("keeper_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("keeper").alias("refers_to"))
    own = records.where("type = 'response'").select(F.col("page").alias(id_col), F.col("size").alias("payload_bytes"), F.col("body_digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), label="op8")
