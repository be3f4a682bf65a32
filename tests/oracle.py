"""Run a query and its SQL on the same tables and compare their rows, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        rows = got.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted([cell(r[c]) for c in order] for r in df.collect())
    theirs = sorted([cell(r[names.index(c)]) for c in order] for r in rows)
    assert ours == theirs
