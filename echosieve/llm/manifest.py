"""Merkle manifest of a table: a digest for every row, group and the whole, with proofs.

Rows are numbered by a range partition: counts per partition give offsets, so no task
sees more than its range. A tree is reduced in superblocks: FANOUT ** LEVELS neighbours
collapse to one node in a task, whatever the group's size, and the blocks' roots are
reduced likewise. Small trees that begin near each other share a block. Proofs go the
other way: a block joins the proof of its root, the upper part, with the lower part that
it recomputes itself, so no proof is ever shuffled with a row."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echosieve.llm.common import Scratch, parallelism

FANOUT, LEVELS = 3, 6
BLOCK = FANOUT**LEVELS
_NODE = "tree long, n long, idx long, digest string"
_PROOF = "lefts array<string>, rights array<string>, subroot string, root string"


def row_digest(fields: list[Column]) -> Column:
    """sha256 of the fields: `-` if null, else UTF-8 length, colon and value."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def numbered(scratch: Scratch, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with `part` and `index`, their place from 0 in the order of `by`, nulls first."""
    laid = rows.repartitionByRange(parallelism(rows.sparkSession), *by).sortWithinPartitions(*by)
    laid = scratch.save(laid.withColumn("at", F.monotonically_increasing_id()), name)
    part, local = F.shiftright("at", 33).cast("int"), F.col("at").bitwiseAND((1 << 33) - 1)
    laid = laid.select(*rows.columns, part.alias("part"), local.alias("local"))
    offsets, before = [], 0
    for r in sorted(laid.groupBy("part").count().collect()):  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return laid.join(F.broadcast(offsets), "part").withColumn("index", F.col("before") + F.col("local")).drop("before", "local")


def _blocks(nodes: DataFrame, single: Column, idx: Column) -> DataFrame:
    """Adds the block a node belongs to: of its tree, or of all small trees that begin near it."""
    return nodes.withColumn("of", F.when(single, -1).otherwise(F.col("tree"))).withColumn("block", F.when(single, F.expr(f"tree div {BLOCK}")).otherwise(idx))


def _low(nodes: DataFrame) -> DataFrame:
    return _blocks(nodes, F.col("n") <= BLOCK, F.expr(f"idx div {BLOCK}"))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _heights(digests: list[str], n: int) -> list[list[str]]:
    """The levels of a block from its leaves to its root; a whole tree ends at its own."""
    out = [digests]
    while len(out[-1]) > 1 or (n > BLOCK and len(out) <= LEVELS):
        d = out[-1]
        out.append([_hash("".join(d[k : k + FANOUT])) for k in range(0, len(d), FANOUT)])
    return out


def _trees(group: pd.DataFrame):
    """The rows of each tree of a block, in order."""
    group = group.sort_values(["tree", "idx"], kind="stable")
    cuts = np.flatnonzero(np.diff(group["tree"].to_numpy())) + 1
    for a, b in zip([0, *cuts], [*cuts, len(group)]):
        yield group.iloc[a:b]


def _collapse(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for part in _trees(group):
        tree, n, idx = (int(part[c].iloc[0]) for c in ("tree", "n", "idx"))
        out.append((tree, -(-n // BLOCK), idx // BLOCK, _heights(part["digest"].tolist(), n)[-1][0]))
    return pd.DataFrame(out, columns=["tree", "n", "idx", "digest"])


def reduce_up(scratch: Scratch, nodes: DataFrame) -> list[DataFrame]:
    """nodes(tree, n, idx, digest) and what their blocks collapse to, until every tree is one node."""
    levels = [nodes]
    while not levels[-1].where("n > 1").isEmpty():
        rows = _low(levels[-1].select("tree", "n", "idx", "digest"))
        levels.append(scratch.save(rows.groupBy("of", "block").applyInPandas(_collapse, _NODE), "nodes"))
    return levels


def _extend(low: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block with their siblings of every level up to the root, in order."""
    above = {(t, k): (list(x), list(y), s, r) for t, k, x, y, s, r in zip(up["tree"], up["idx"], up["lefts"], up["rights"], up["subroot"], up["root"])}
    out = []
    for part in _trees(low):
        lefts, rights, subroot, root = above[(int(part["tree"].iloc[0]), int(part["idx"].iloc[0]) // BLOCK)]
        heights = _heights(part["digest"].tolist(), int(part["n"].iloc[0]))[:-1]
        rows = []
        for k in range(len(part)):
            x, y = [], []
            for d in heights:
                first = k - k % FANOUT
                x.append("".join(d[first:k]))
                y.append("".join(d[k + 1 : first + FANOUT]))
                k //= FANOUT
            rows.append((x + lefts, y + rights, subroot, root))
        out.append(part.assign(**{c: v for c, v in zip(("lefts", "rights", "subroot", "root"), map(list, zip(*rows)))}))
    return pd.concat(out).drop(columns=["of", "block"])


def pass_down(scratch: Scratch, levels: list[DataFrame], proofs: DataFrame) -> DataFrame:
    """The rows of levels[0] with their proofs; `proofs` has those of the trees' roots."""
    for depth in range(len(levels) - 2, -1, -1):
        low = _low(levels[depth])
        up = _blocks(proofs.select("tree", "n", "idx", "lefts", "rights", "subroot", "root"), F.col("n") == 1, F.col("idx"))
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in levels[depth].schema)
        proofs = low.groupBy("of", "block").cogroup(up.groupBy("of", "block")).applyInPandas(_extend, f"{kept}, {_PROOF}")
        if depth:
            proofs = scratch.save(proofs, "proofs")
    return proofs


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, label: str = "manifest") -> DataFrame:
    """(id_col, leaf, subroot, root, lefts, rights) of every row, and the columns of `carry`,
    expressions over docs. Leaves of a group ascend by id, groups by name, null first; what
    shares an id is ordered by its digest, and repeated rows are leaves of their own. A
    group of one row is its own subroot, a table of one group has its subroot as root, and
    an empty table gives no rows. lefts[k] and rights[k] are the joined digests beside the
    node of level k. Columns not named are ignored, whatever they are called."""
    scratch = Scratch(docs.sparkSession, label)
    carry = carry or {}
    extra = [c.alias(f"x{k}") for k, c in enumerate(carry.values())]
    leaves = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("name"), row_digest([F.col(f) for f in fields]).alias("digest"), *extra), "leaves")
    rows = numbered(scratch, leaves, ["name", "id", "digest"], "ordered")
    # a group's first place and size, from one row a partition and group
    runs = rows.groupBy("part", "name").agg(F.count("*").alias("here"), F.min("index").alias("least"))
    group = W.partitionBy("name")
    runs = runs.select(F.col("part").alias("p"), F.col("name").alias("g"), F.sum("here").over(group).alias("n"), F.min("least").over(group).alias("tree"))
    rows = rows.join(runs, (F.col("part") == F.col("p")) & F.col("name").eqNullSafe(F.col("g")))
    rows = rows.select("tree", "n", (F.col("index") - F.col("tree")).alias("idx"), "digest", "id", *[f"x{k}" for k in range(len(carry))])
    levels = reduce_up(scratch, scratch.save(rows, "rows"))
    tops = numbered(scratch, levels[-1].select("tree", "digest"), ["tree"], "groups")
    count = tops.count()
    above = reduce_up(scratch, scratch.save(tops.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("index").alias("idx"), "digest", F.col("tree").alias("group")), "roots"))
    none = F.array().cast("array<string>")
    crown = above[-1].select("tree", "n", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    if len(above) == 1:
        crown = above[0].select("digest", "group", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root"))
    else:
        crown = pass_down(scratch, above, crown)
    proofs = scratch.save(crown.select(F.col("group").alias("tree"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("digest").alias("subroot"), "root"), "subroots")
    if len(levels) == 1:
        out = levels[0].join(proofs.drop("n", "idx"), "tree")
    else:
        out = pass_down(scratch, levels, proofs)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "lefts", "rights", *[F.col(f"x{k}").alias(c) for k, c in enumerate(carry)])


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id isn't tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = row_digest([*[F.col(f) for f in fields[:-1]], F.replace("text", F.lit("\n"), F.lit(""))])
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed)
    made = manifest(docs, fields, carry={"changed": changed}, label="op11")
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda x, y: F.concat(x, y)), "")
    fold = folded(F.coalesce("changed", "leaf"), F.col("lefts"), F.col("rights"))
    out = made.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", fold)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL has: enough for FANOUT ** 12 rows a group.
_SQL_LEVELS = 12


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_concat([xor(h, c)], range(8)), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, c: {bits}))"


def _tree_sql(leaves: str, tree: str, out: str) -> str:
    """CTEs that reduce `leaves`(tree, idx, digest) a level at a time and give `out`(tree, idx,
    root, lefts, rights); a tree that is one node stays as it is."""
    ctes = [f"{out}0 AS (SELECT {tree} AS tree, idx, digest, count(*) OVER (PARTITION BY {tree}) AS n FROM {leaves})"]
    for k in range(_SQL_LEVELS):
        ctes.append(
            f"{out}{k + 1} AS (SELECT tree, idx // {FANOUT} AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, any_value((n + {FANOUT - 1}) // {FANOUT}) AS n FROM {out}{k} WHERE n > 1 GROUP BY tree, idx // {FANOUT} UNION ALL SELECT tree, idx, digest, n FROM {out}{k} WHERE n = 1)"
        )
    sides = "UNION ALL ".join(
        f"SELECT l.tree, l.idx, {k} AS level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < x.idx), '') AS l, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > x.idx), '') AS r FROM {out}0 l JOIN {out}{k} x ON x.tree IS NOT DISTINCT FROM l.tree AND x.idx = l.idx // {FANOUT**k} JOIN {out}{k} s ON s.tree IS NOT DISTINCT FROM x.tree AND s.idx // {FANOUT} = x.idx // {FANOUT} WHERE x.n > 1 GROUP BY l.tree, l.idx "
        for k in range(_SQL_LEVELS)
    )
    ctes.append(f"{out}_sides AS ({sides})")
    return ", ".join(ctes)


def _sql() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    own = [part(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    cut = [*own[:-1], part("replace(text, chr(10), '')")]
    crc = _crc32_sql("doc_id::VARCHAR")
    return f"""WITH docs AS (SELECT doc_id, source, sha256({' || '.join(own)}) AS digest, CASE WHEN {crc} % 2 = 0 THEN sha256({' || '.join(cut)}) END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM docs),
{_tree_sql('leaves', 'source', 't')},
groups AS (SELECT tree AS source, digest, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS idx FROM t{_SQL_LEVELS}),
{_tree_sql('groups', '0', 'g')},
proof AS (SELECT l.source, l.idx, list({{'l': s.l, 'r': s.r}} ORDER BY s.level) AS sides FROM leaves l JOIN (SELECT tree AS source, idx, level, l, r FROM t_sides UNION ALL SELECT w.source, lv.idx, 100 + gs.level, gs.l, gs.r FROM g_sides gs JOIN groups w ON w.idx = gs.idx JOIN leaves lv ON lv.source IS NOT DISTINCT FROM w.source) s ON s.source IS NOT DISTINCT FROM l.source AND s.idx = l.idx GROUP BY l.source, l.idx),
whole AS (SELECT l.doc_id, l.digest AS leaf, w.digest AS subroot, (SELECT digest FROM g{_SQL_LEVELS}) AS root, coalesce(p.sides, []) AS sides, coalesce(l.changed, l.digest) AS start FROM leaves l JOIN groups w ON w.source IS NOT DISTINCT FROM l.source LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM l.source AND p.idx = l.idx),
folded AS (SELECT *, list_reduce(list_concat([start], list_transform(sides, lambda s: s.l || '-' || s.r)), lambda h, s: sha256(string_split(s, '-')[1] || h || string_split(s, '-')[2])) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


ORACLE = _sql()
