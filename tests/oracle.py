"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{sf_dir}/{name}')")
    return con


def plain(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def value(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False, name=None)), key=str)


def agree(spark, con, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
