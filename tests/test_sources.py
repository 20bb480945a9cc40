"""Loading, storing and asking for data."""

import datetime

import pytest

from rekit import session
from rekit.operators import inventory
from rekit.sources import tables as sources
from rekit.sources.adapter import from_star_schema
from rekit.sources.requests import (
    in_serial_order,
    invalid_serials,
    on_site_serials,
    read_requests,
    split_requests,
)
from rekit.sources.schema import SCHEMAS
from tests.conftest import DAY
from tests.test_report_random import warehouse

SF_DIR = "/root/testdata/sf0.001"


def test_parquet_round_trip_and_partition_pruning(spark, make_tables, tmp_path, rows):
    tables = make_tables(**warehouse(5))
    sources.write_parquet(tables, str(tmp_path))
    loaded = sources.read_parquet(spark, str(tmp_path), as_of=DAY)
    for name, schema in SCHEMAS.items():
        frame = getattr(loaded, name)
        assert [(f.name, f.dataType) for f in frame.schema] == [
            (f.name, f.dataType) for f in schema
        ]
        assert rows(frame) == rows(getattr(tables, name))
    plan = inventory.warehouse_availability(loaded)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_dte" in plan
    assert "PushedFilters: [IsNotNull(warehouse_id), EqualTo(warehouse_id,E01)" in plan


def test_snapshot_day(make_tables, rows):
    other = DAY + datetime.timedelta(days=1)
    tables = make_tables(
        daily_snapshot=[
            dict(prod_id="a", on_hand=9, on_reserve=2, unavailable=1),
            dict(prod_id="a", on_hand=None),
            dict(prod_id="a", on_hand=5, snapshot_dte=other),
            dict(prod_id="b", on_hand=5, warehouse_id="E02"),
        ]
    )
    assert rows(inventory.warehouse_availability(tables)) == [("a", 6)]
    assert rows(inventory.warehouse_availability(tables.with_settings(as_of=other))) == [("a", 5)]
    today = tables.with_settings(as_of=None)
    assert rows(inventory.warehouse_availability(today)) == []


def test_codes_are_settings(make_tables, rows):
    tables = make_tables(
        stock=[
            dict(id=1, product_id=1, stock_type=3),
            dict(id=2, product_id=2, stock_type=9),
            dict(id=3, product_id=3, stock_type=3, inventory_type=2),
        ]
    )
    assert rows(inventory.unique_kits(tables)) == [(1,)]
    other = tables.with_settings(codes=sources.InventoryCodes(valid_kit=9))
    assert rows(inventory.unique_kits(other)) == [(2,)]


def test_jdbc_wants_growing_tables_split(spark):
    with pytest.raises(ValueError, match="daily_snapshot, product_serial"):
        sources.read_jdbc(spark, {}, splits={"stock": {}})


def test_jdbc_options(monkeypatch):
    for name in ("URL", "USER", "PASSWORD"):
        monkeypatch.delenv(f"REKIT_JDBC_{name}", raising=False)
    with pytest.raises(ValueError):
        sources.jdbc_options("stock")
    monkeypatch.setenv("REKIT_JDBC_URL", "jdbc:example:db")
    split = dict(column="id", lower=0, upper=1000, partitions=8)
    assert sources.jdbc_options("w.stock", split, user="reader") == {
        "url": "jdbc:example:db",
        "user": "reader",
        "dbtable": "w.stock",
        "fetchsize": "10000",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "1000",
        "numPartitions": "8",
    }


def test_tables_are_loaded_once_and_only_when_asked_for(spark):
    asked = []

    def load(name):
        asked.append(name)
        return spark.createDataFrame([], SCHEMAS[name])

    tables = sources.Tables(spark, load)
    inventory.warehouse_availability(tables)
    inventory.warehouse_availability(tables.with_settings(storing=False))
    assert asked == ["daily_snapshot"]


def test_kit_units_are_stored_once_for_all_reports(make_tables):
    tables = make_tables(**warehouse(0))
    files = {
        path
        for operator in (inventory.unique_kits, inventory.kit_bins, inventory.kit_serials)
        for path in operator(tables).inputFiles()
    }
    assert files == set(inventory.kit_units(tables).inputFiles())


def test_adapter_sizes(spark):
    """Row counts known for this data."""
    tables = from_star_schema(spark, SF_DIR)
    counts = {r.stock_type: r["count"] for r in tables.stock.groupBy("stock_type").count().collect()}
    assert counts == {1: 398, 2: 1117, 3: 27, 4: 53}
    for name, schema in SCHEMAS.items():
        assert dict(getattr(tables, name).dtypes) == {
            f.name: f.dataType.simpleString() for f in schema
        }


def test_stored_frames_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_dir(spark) == shared
    stored = session.store(spark.range(5))
    assert stored.count() == 5
    assert all(shared in path for path in stored.inputFiles())


def test_explicit_settings_win(spark):
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_read_requests(spark, tmp_path, rows):
    (tmp_path / "wanted.csv").write_text(
        "kit_number,serial_number,build_pos\nK-1,9,1\nK-1,03,2\nK-1,9,3\nK-2,none,1\n"
    )
    raw = read_requests(spark, str(tmp_path / "wanted.csv"))
    accepted, rejected = split_requests(raw)
    assert rows(accepted, "kit_number", "serial_number", "build_pos") == [
        ("K-1", 3, 2),
        ("K-1", 9, 1),
    ]
    assert rows(rejected) == [("K-2", "none", 1)]


def test_derived_requests(make_tables, rows):
    tables = make_tables(
        product=[
            dict(id=1, product_number="K-1"),
            dict(id=2, product_number="ZPB-2"),
            dict(id=3, product_number="K-3"),
        ],
        bin=[dict(id=1), dict(id=2, position=None)],
        product_serial=[dict(id=i, serial_number=100 - i) for i in range(1, 8)],
        stock=[
            dict(id=1, product_id=1, serial_id=1, stock_type=4, container_id=1),
            dict(id=2, product_id=1, serial_id=2, stock_type=3, container_id=1),
            dict(id=3, product_id=1, serial_id=3, stock_type=4, container_id=2),
            dict(id=4, product_id=1, serial_id=4, stock_type=4, container_id=1, location_id=9),
            dict(id=5, product_id=2, serial_id=5, stock_type=4, container_id=1),
            # its only bin has no label, so the report leaves the kit out
            dict(id=6, product_id=3, serial_id=6, stock_type=4, container_id=2),
            dict(id=7, product_id=1, serial_id=None, stock_type=4, container_id=1),
        ],
    )
    assert rows(in_serial_order(invalid_serials(tables)), "build_pos", "serial_number") == [
        (1, 97),
        (2, 99),
    ]
    assert rows(on_site_serials(tables), "serial_number") == [(97,), (98,), (99,)]
