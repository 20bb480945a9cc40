"""Every query against its check SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("part", "lineitem", "nation"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def ordered(found, columns):
    positions = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in positions) for row in found), key=repr)


OWN = sorted(set(entry.queries()) - set(entry.LLM_QUERIES))


@pytest.mark.parametrize("name", OWN)
def test_query_equals_check_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    expected = duck.execute(entry.oracle_sql()[name])
    types = {column[0]: str(column[1]) for column in expected.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    got = ordered([tuple(row) for row in df.collect()], df.columns)
    assert got == ordered(expected.fetchall(), list(types))
    assert got


def test_entry_counts_rebuilds(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "kit_number",
        "slots",
        "valid_kits",
        "invalid_kits",
        "total_pieces",
        "leftover_pieces",
    ]
    assert df.count() > 0


def test_known_totals_with_all_serials(spark):
    """Valid kits counted once for this data: without and with repeated rows."""
    for name, expected in (
        ("reassembly_summary_all_serials", 11),
        ("reassembly_summary_all_serials_as_reported", 28),
    ):
        summary = entry.queries()[name](spark, SF_DIR)
        assert summary.groupBy().sum("slots", "valid_kits").first() == (61, expected)
