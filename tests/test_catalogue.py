import math

import duckdb
import pytest

from tallyframe.operators import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark part orders".split()


def rows(frame, columns):
    def plain(v):
        return None if v is None or isinstance(v, float) and math.isnan(v) else int(v) if hasattr(v, "as_integer_ratio") and float(v).is_integer() else v

    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_points():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(catalogue.QUERIES) <= names and set(entry.oracle_sql()) <= names
