"""Every registered query of the panel library against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names():
    from crosspanel import queries

    return sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from crosspanel import queries

    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if sql := queries.oracle_sql().get(name):
        found = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
        assert got == sorted(tuple(map(plain, r)) for r in found)


def test_flagship_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["date", "value"] and df.count() > 100


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grids_and_catalogues_hold_every_id(spark, duck):
    from crosspanel import queries

    found, one = queries.queries(), lambda sql: duck.execute(sql).fetchone()[0]
    for name, sql in {
        "j04_asof_fill": "SELECT count(DISTINCT o_custkey) FROM orders",
        "f10_ingest_monthly": "SELECT count(DISTINCT o_custkey) FROM orders",
        "f06_to_daily": "SELECT count(*) FROM part",
        "f07_sector_panel": "SELECT count(*) FROM part",
        "f08_ratio_panels": "SELECT count(*) FROM part",
    }.items():
        assert found[name](spark, SF).select("symbol").distinct().count() == one(sql), name
    catalogue = found["s15_evolve_schema"](spark, SF).count()
    for name in ("s14_append_new", "s14_append_counts"):
        assert sum(found[name](spark, SF).first()) == catalogue, name
