"""Every query with SQL gives what another engine gives on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from inkframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def other(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, small, other, name):
    frame = catalog.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    found = other.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert mine == theirs


@pytest.mark.parametrize("name", ["tail_rays", "tail_fusion"])
def test_tail_without_direction(spark, tmp_path, name):
    """A text and its tail have one centre; of the two bodies in their panel, one contains it."""
    c = duckdb.connect()
    rows = "(97472, 5, 10163, 586, 7.0), (97473, 1, 11572, 809, 14.0), (97472, 1, 214, 6, 10.0), (97472, 2, 25, 4, 10.0), (97472, 2, 1, 0, 10.0)"
    c.sql(f"""COPY (SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, q::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice,
      0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, TIMESTAMP '1995-01-01' AS l_shipdate FROM (VALUES {rows}) t(o, n, p, s, q)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    c.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    frame = catalog.QUERIES[name](spark, str(tmp_path))
    theirs = c.execute(f"SELECT {', '.join(frame.columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert len(theirs) == 2 and sorted(map(tuple, frame.collect())) == sorted(theirs)


def test_fused_sign_of_zero(spark, tmp_path):
    """Six times the prior and the score cancel but for the last bit: -0.0 on two pages."""
    c = duckdb.connect()
    rows = "(3, 6, 2689, 163, 8), (5, 7, 5626, 319, 6), (1, 1, 229, 826, 23), (1, 3, 951, 1327, 35), (1002, 3, 11540, 776, 16), (1007, 4, 13379, 889, 37), (1009, 5, 19441, 298, 29), (1004, 1, 9070, 660, 17)"
    c.sql(f"""COPY (SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, q::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice,
      0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, TIMESTAMP '1995-01-01' AS l_shipdate FROM (VALUES {rows}) t(o, n, p, s, q)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    c.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    frame = catalog.QUERIES["tail_fusion"](spark, str(tmp_path))
    theirs = c.execute(f"SELECT {', '.join(frame.columns)} FROM ({catalog.SQL['tail_fusion']})").fetchall()
    assert [math.copysign(1, r[frame.columns.index("fused")]) for r in theirs] == [-1, -1]
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
