"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from leontia import queries, source_queries

QUERIES, SQL = queries.QUERIES | source_queries.QUERIES, queries.SQL | source_queries.SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
SAMPLE = ["sum_by_country_both", "aggregate_rows_median", "matrix_summary", "rows_by_key_list", "drop_cols_keys", "slice_rows", "from_long_roundtrip", "pivot_wide", "technical_coefficients", "environmental_impact_scenarios", "mrio_aggregate_cols_env", "sut_to_io_A", "empty_region_prune", "country_summary", "inverse_column_by_key", "places_both", "series_places", "head", "sizes_are_checked", "sub_system_output", "impact_of_arrays", "from_long_last_wins"]
SAMPLE += ["eora_extension", "eora_sub_system", "number_tokens", "release_use", "release_sizes", "release_Z_zipped", "release_extension", "release_VA", "safe_table"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_names():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["row_CountryCode", "col_CountryCode", "value"]


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert len(want)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(([round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r] for r in d[columns].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)
