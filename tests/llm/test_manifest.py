import hashlib
import random
import zlib

from pyspark.sql import functions as F

from echosieve.llm import manifest as M
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree long, idx int, root string, part int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def sides(tree, k):
    out = []
    for d in tree[:-1]:
        a = k - k % 3
        out.append(("".join(d[a:k]), "".join(d[k + 1 : a + 3])))
        k //= 3
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    of = {}
    for r in rows:
        of.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(of[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names]) if names else []
    out = []
    for j, s in enumerate(names):
        for k, (_, _, d, r) in enumerate(sorted(of[s], key=lambda x: x[:3])):
            proof = sides(trees[s], k) + sides(top, j)
            start = d
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                start = leaf([*r[:4], r[4].replace("\n", "")])
            h = start
            for x, y in proof:
                h = H(x, h, y)
            out.append((r[0], d, trees[s][-1][0], top[-1][0], H(*[x + y for x, y in proof]), h, h == top[-1][0]))
    return sorted(out, key=str)


def got(spark, tmp_path, rows):
    path = str(tmp_path / f"t{len(rows)}-{random.random()}")
    spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(3).write.parquet(path + "/documents.parquet")
    out = M.op11_manifest(spark, path)
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_query_equals_sql(spark):
    assert differences(spark, connect(SF), M.op11_manifest, M.ORACLE, SF) == ""


def test_hot_source_edges_and_ties(spark, tmp_path):
    rows = [(i, "hot", "en", i % 7, f"text\n{i}") for i in range(2300)]
    rows += [(i, f"s{i % 61}", None, None, "é\n" * (i % 5)) for i in range(3000, 3400)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, "no id\n"), (5, None, "de", 2, None), (5, None, "de", 2, ""), (7, "é", "", 0, "\n" * 50_000), (8, "z", "", 0, "a\n"), (9, "", None, None, "empty name")]
    rows += [(9001, "same", "x", 1, "twice\n")] * 5 + [(4000 + k, "729", "x", 1, str(k)) for k in range(729)] + [(6000 + k, "730", "x", 1, str(k)) for k in range(730)]
    random.Random(1).shuffle(rows)
    assert got(spark, tmp_path, rows) == brute(rows)


def test_small_tables(spark, tmp_path):
    for rows in ([], [(1, "a", "b", 1, "c\n")], [(2, None, None, None, None), (4, "x", "y", 1, "q\n")], [(k, f"s{k}", "e", 1, "t\n") for k in range(1600)]):
        assert got(spark, tmp_path, rows) == brute(rows)


def test_proofs_fold_to_the_root_and_only_they(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    made = M.manifest(docs, ["doc_id", "text"])
    fold = M.folded(F.col("leaf"), F.col("lefts"), F.col("rights"))
    other = M.folded(F.sha2("leaf", 256), F.col("lefts"), F.col("rights"))
    assert made.where(fold == F.col("root")).count() == 900 and made.where(other == F.col("root")).count() == 0
