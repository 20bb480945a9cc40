"""Reports on random small warehouses full of irregular rows, against the check SQL,
which builds the report row by row.

The rows include products sharing a number, several lots, unknown quantities, serials
and bin parts, repeated and missing bills of materials, and units stored off site.
"""

import random

import duckdb
import pandas as pd
import pytest

from checks import oracle
from rekit.operators import breakout, inventory, standard
from rekit.sources import requests
from tests.conftest import DAY

RENAMED = """
bin AS (SELECT * FROM t_bin),
labelled_bin AS (SELECT *, zone || '-' || position || '-' || shelf AS label FROM bin),
product AS (SELECT id, product_number AS number, edi_number AS edi, description FROM t_product),
bom AS (SELECT product_id AS kit_id, component_product_id AS part_id, quantity
        FROM t_product_component),
serial AS (SELECT id, serial_number AS number FROM t_product_serial),
stock AS (SELECT id, product_id, serial_id, stock_type AS kind, inventory_type AS inventory,
                 location_type AS place_type, location_id AS place, container_type AS holder_type,
                 container_id AS holder, quantity_on_hand AS on_hand,
                 quantity_available AS available FROM t_stock),
snapshot AS (SELECT prod_id AS edi, snapshot_dte AS day, warehouse_id AS warehouse, on_hand,
                    on_reserve, unavailable FROM t_daily_snapshot)
"""


def warehouse(seed):
    rnd = random.Random(seed)
    pick = rnd.choice
    kits = [
        dict(id=1000 + i, product_number=n, edi_number=e, description=d)
        for i, (n, e, d) in enumerate(
            [
                ("K-1", "E1", "kit one"),
                ("K-2", "E2", "kit two"),
                ("K-2", "E2b", "kit two again"),
                ("K-3", "E3", "kit three"),
                ("K-3", "E3", "kit three renamed"),
                ("ZPB-9", "E9", "left out"),
                (None, "E0", "unnumbered"),
                ("K-4", None, "no edi"),
            ]
        )
    ]
    parts = [
        dict(
            id=i,
            product_number=pick([f"C-{i}", f"C-{i}", "C-same", None]),
            edi_number=pick([f"{i:03}", f"{i:03}", "same", None]),
            description=pick(["x", "y", None]),
        )
        for i in range(1, 9)
    ]
    bins = [
        dict(
            id=i,
            zone=pick(["G1", "G2", "R1", "R2", "S1", None]),
            position=pick(["01", "02", None]),
            shelf=pick(["A", "A", None]),
        )
        for i in range(1, 13)
    ]
    serials = [dict(id=i, serial_number=pick([1, 2, 3, 4, None])) for i in range(1, 13)]
    bom = [
        dict(
            product_id=kit["id"],
            component_product_id=rnd.randint(1, 8),
            quantity=pick([1, 1, 2, 3, 0, None]),
        )
        for kit in kits[:-1]
        for _ in range(rnd.randint(0, 5))
    ]
    stock = []

    def add(**row):
        stock.append(dict(id=len(stock) + 1) | row)

    for _ in range(30):
        add(
            product_id=pick(kits)["id"],
            serial_id=pick([None, *range(1, 14)]),
            stock_type=pick([3, 4, 4]),
            inventory_type=pick([3, 3, 3, 2]),
            location_id=pick([370, 370, 370, 371]),
            container_type=pick([1, 1, 1, 2]),
            container_id=rnd.randint(1, 13),
            quantity_on_hand=pick([1, 1, 0, None]),
        )
    for _ in range(60):
        add(
            product_id=rnd.randint(1, 9),
            stock_type=pick([2, 2, 2, 2, 1]),
            location_id=pick([370, 370, 370, 371]),
            container_type=pick([2, 2, 2, 1]),
            container_id=rnd.randint(1, 34),
            quantity_available=pick([0, 1, 2, 3, None, -1]),
        )
    for _ in range(25):
        add(
            product_id=rnd.randint(1, 9),
            stock_type=1,
            container_type=1,
            container_id=rnd.randint(1, 13),
            quantity_available=pick([0, 1, 2, 5, None]),
        )
    snapshot = [
        dict(
            prod_id=pick(["001", "002", "003", "same"]),
            warehouse_id=pick(["E01", "E01", "E02"]),
            on_hand=pick([5, 7, None]),
            on_reserve=pick([0, 1]),
            unavailable=pick([0, 2]),
        )
        for _ in range(8)
    ]
    return dict(
        product=kits + parts,
        product_component=bom,
        product_serial=serials,
        bin=bins,
        stock=stock,
        daily_snapshot=snapshot,
    )


class Check:
    def __init__(self, tables):
        self.duck = duckdb.connect()
        for name in (
            "stock", "product", "product_component", "product_serial", "bin", "daily_snapshot"
        ):
            frame = getattr(tables, name)
            data = pd.DataFrame([r.asDict() for r in frame.collect()], columns=frame.columns)
            data = data.astype(object).where(data.notna(), None)
            kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE"}
            columns = ", ".join(f"{f.name} {kinds[f.dataType.simpleString()]}" for f in frame.schema)
            self.duck.execute(f"CREATE TABLE t_{name} ({columns})")
            if len(data):
                marks = ", ".join("?" for _ in data.columns)
                self.duck.executemany(
                    f"INSERT INTO t_{name} VALUES ({marks})", data.values.tolist()
                )

    def __call__(self, name):
        if name in oracle.PLAIN:
            parts, select = [], oracle.PLAIN[name]
            requested = oracle.INVALID_ONLY
        else:
            select, pool, requested = oracle.REBUILT[name]
            parts = [pool, oracle.REBUILD]
        relations = oracle.RELATIONS.replace("{requested}", requested).replace(
            "DATE '2001-01-04'", f"DATE '{DAY}'"
        )
        pieces = [p.strip("\n") for p in (RENAMED, relations, *parts)]
        return self.duck.execute("WITH " + ",".join(pieces) + select)


def same(df, expected):
    columns = [c[0] for c in expected.description]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(expected.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("seed", range(2))
def test_reports(spark, make_tables, seed):
    tables = make_tables(**warehouse(seed))
    check = Check(tables)
    for name, operator in (
        ("unique_kits", inventory.unique_kits),
        ("loose_availability", inventory.loose_availability),
        ("kit_validity_by_type", inventory.kit_validity_by_type),
        ("kit_percent_invalid", inventory.kit_percent_invalid),
        ("serial_contents", inventory.serial_contents),
        ("warehouse_availability", inventory.warehouse_availability),
        ("kit_serials", inventory.kit_serials),
        ("kit_bins", inventory.kit_bins),
        ("kit_universe", standard.kit_universe),
        ("kit_components", standard.kit_components),
        ("kit_standard", standard.kit_standard),
        ("kit_standard_size", standard.kit_standard_size),
        ("serial_kit_grid", breakout.serial_kit_grid),
        ("pieces_missing", breakout.pieces_missing),
        ("kit_breakout", breakout.kit_breakout),
    ):
        same(operator(tables), check(name))


@pytest.mark.parametrize("seed", [100, 103])
def test_requested_serials(spark, make_tables, seed):
    tables = make_tables(**warehouse(seed))
    check = Check(tables)
    wanted = tables.shared(requests.invalid_serials(tables))
    assert wanted.count() > 0
    for name, operator in (
        ("serial_diff", breakout.serial_diff),
        ("serial_missing_components", breakout.serial_missing_components),
        ("serial_breakout", breakout.serial_breakout),
    ):
        same(operator(tables, wanted), check(name))
    same(requests.in_serial_order(wanted), check("invalid_serial_requests"))


def test_the_random_warehouses_hold_the_irregular_cases(make_tables, spark):
    """Repeated rows, unknown serials and several content rows per component do occur."""
    seen = {"null serial": 0, "several contents": 0, "repeated": 0}
    for seed in range(4):
        report = breakout.kit_breakout(make_tables(**warehouse(seed))).toPandas()
        seen["null serial"] += int(report["serial_number"].isna().sum())
        seen["repeated"] += int(report.duplicated(report.columns[:9].tolist()).sum())
        contents = inventory.serial_contents(make_tables(**warehouse(seed))).toPandas()
        seen["several contents"] += int(
            contents.duplicated(["kit_prod_number", "serial_number", "component_edi"]).sum()
        )
    assert all(seen.values()), seen
