"""Runs a query and its SQL on the same files and compares rows as multisets."""

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)


def rows_of_sql(sql, data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=key)


def same(query, sql, spark, data):
    columns, rows = rows_of(query(spark, data))
    wanted_columns, wanted = rows_of_sql(sql, data)
    assert columns == wanted_columns
    assert len(rows) == len(wanted)
    assert rows == wanted
