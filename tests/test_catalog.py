"""Every registered query against its SQL in DuckDB, over the small tables."""

import math
import os

import duckdb
import pytest

from nightloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[i] for i in order)) for r in values]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DATA)
    found = got.collect()
    assert found
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    for a, b in zip(rows(got.columns, found), rows(names, cursor.fetchall()), strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_a_bad_box_and_a_bad_matrix_are_refused(spark):
    from nightloom.functions import pixels

    with pytest.raises(ValueError):
        pixels.crop(None, 10, 10, 5, 0, 5)
    with pytest.raises(ValueError):
        pixels.colour_matrix(None, ((1, 0), (0, 1)))
    with pytest.raises(ValueError):
        pixels.curves(None, mode="other")
