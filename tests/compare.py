"""Compare queries with their DuckDB SQL: row counts, column names, values."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            p = p + "/*.parquet" if os.path.isdir(p) else p
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{glob.escape(p) if '*' not in p else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[k]) for k in order) for r in rel.fetchall())
    if got == want:
        return "" if got else "no rows on either side"
    a, b = set(got) - set(want), set(want) - set(got)
    return f"rows {len(got)} and {len(want)}; only Spark {sorted(a)[:2]}; only DuckDB {sorted(b)[:2]}"
