import os

import pytest

from snapforge import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    cur = duck.execute(catalog.SQL[name])
    cols, want = [c[0] for c in cur.description], cur.fetchall()
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    assert sorted(repr(tuple(map(plain, r))) for r in got) == sorted(repr(tuple(map(plain, r))) for r in want)


def test_blob_lookup_over_all_origins_gives_the_rows_of_its_sql(spark, duck):
    cur = duck.execute(catalog.BLOB_LOOKUP_WHOLE)
    cols, want = [c[0] for c in cur.description], cur.fetchall()
    got = catalog.QUERIES["blob_lookup_whole"](spark, SF).select(*cols).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got) and len(got) > 10


def test_expected_counts_of_matching(spark):
    """23 renames by content and 19 by name on this table."""
    got = catalog.QUERIES["rename_fuzzy"](spark, SF).groupBy("pass").count().collect()
    assert {r["pass"]: r["count"] for r in got} == {1: 23, 2: 19}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_bijection_over_all_lines_is_the_sequential_assignment(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    edges = sorted((-((o * 31 + p * 17) % 97 / 97.0), f"t{o:012d}", f"s{p:012d}") for o, p in rows)
    used, want = set(), set()
    for w, t, s in edges:
        if t not in used and s not in used:
            used |= {t, s}
            want.add((t, s, round(-w, 9)))
    got = catalog.QUERIES["bijection_whole"](spark, SF).collect()
    assert {(r.target_path, r.source_path, round(r.score, 9)) for r in got} == want and len(got) == len(want)
