"""Comparison of a query with its DuckDB SQL on the small driver tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(table):
    """Sorted rows of an Arrow table, doubles to nine digits."""
    names = sorted(table.column_names)
    show = lambda v: ("nan" if v != v else repr(round(v, 9) + 0.0)) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[c]) for c in names) for r in table.to_pylist())


def assert_equal(spark, query, sql: str, sf: str = SF) -> None:
    mine, other = query(spark, sf).toArrow(), connection(sf).sql(sql).to_arrow_table()
    assert sorted(mine.column_names) == sorted(other.column_names)
    assert rows(mine) == rows(other)
