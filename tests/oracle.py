"""Compare a query with its SQL in DuckDB."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, names, data):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def check(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows(sorted(names), names, result.fetchall())
    assert rows(sorted(names), df.columns, df.collect()) == expected
