"""Every registered query runs over the smallest tables, and equals its SQL where it has one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from fathomline.plans import registry


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x


def equal_to_sql(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if sql is None:
        return
    base = duckdb.connect()
    base.execute("SET TimeZone='UTC'")
    import pathlib

    for p in pathlib.Path(sf_dir).glob("*.parquet"):
        base.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    rows = base.execute(sql)
    order = sorted(range(len(rows.description)), key=lambda i: rows.description[i][0])
    assert columns == [rows.description[i][0] for i in order]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rows.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, name):
    equal_to_sql(spark, sf_dir, registry.QUERIES[name], registry.ORACLE.get(name))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
