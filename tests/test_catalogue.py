"""Every query against its SQL counterpart on the smallest tables."""

import math

import duckdb
import pytest

from larkspan import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"risk_array_form", "detect_pages"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(rows, columns):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(value(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, sf_dir, name):
    rows = [r.asDict() for r in catalogue.queries()[name](spark, sf_dir).collect()]
    result = duck.sql(catalogue.oracle_sql()[name])
    expected = [dict(zip(result.columns, r)) for r in result.fetchall()]
    columns = sorted(result.columns)
    if rows:
        assert sorted(rows[0]) == columns
    assert plain(rows, columns) == plain(expected, columns)


def test_every_query_has_a_test_or_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"normalize_full", "detect_pages", "detect_documents", "bootstrap_f1", "dom_forms", "detect_cases"}
