"""Derive the six warehouse tables from the star-schema test tables.

Twenty parts make a kit and every kit has eight serials. Numbers, bins, stock
types and quantities follow from the keys, so the same derivation can be written
in SQL for checking.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from rekit.session import store
from rekit.sources.tables import Tables

SNAPSHOT_DAY = datetime.date(2001, 1, 4)
KIT_ID = 1000000000
KIT_OF_PART = "cast(floor({} / 20) as bigint)"


def _digits(key: str, width: int) -> str:
    """The key as text, zero-padded; longer keys keep all their digits."""
    text = f"cast({key} as string)"
    return f"lpad({text}, greatest({width}, length({text})), '0')"


def _kit_keys(part: DataFrame) -> DataFrame:
    return part.selectExpr(f"{KIT_OF_PART.format('p_partkey')} as k").distinct()


def _kit_serials(part: DataFrame) -> DataFrame:
    return _kit_keys(part).selectExpr("k", "explode(sequence(0L, 7L)) as s")


def _product(part: DataFrame) -> DataFrame:
    components = part.selectExpr(
        "p_partkey as id",
        f"'C-' || {_digits('p_partkey', 8)} as product_number",
        f"{_digits('p_partkey', 11)} as edi_number",
        "p_name as description",
    )
    kits = _kit_keys(part).selectExpr(
        f"{KIT_ID} + k",
        f"case when k % 10 = 9 then 'ZPB-' else 'K-' end || {_digits('k', 6)}",
        f"'E' || {_digits('k', 6)}",
        "'kit ' || cast(k as string)",
    )
    return components.union(kits)


def _pieces(lineitem: DataFrame, flag: str, slot: str, quantity: str) -> DataFrame:
    return (
        lineitem.where(f"l_returnflag = '{flag}'")
        .selectExpr("l_partkey", f"{slot} as slot", f"{quantity} as quantity")
        .groupBy("l_partkey", "slot")
        .agg({"quantity": "sum"})
        .withColumnRenamed("sum(quantity)", "quantity")
    )


def _stock(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    units = _kit_serials(part).selectExpr(
        "k * 100 + s as id",
        f"{KIT_ID} + k as product_id",
        "k * 100 + s as serial_id",
        "case when (k + s) % 3 = 0 then 3 else 4 end as stock_type",
        "case when k % 17 = 5 then 2 else 3 end as inventory_type",
        "1 as location_type",
        "case when k % 4 = 0 and s = 7 then 371L else 370L end as location_id",
        "1 as container_type",
        "case when k % 3 = 0 and s >= 4 then (k + 1) % 10 else k % 10 end as container_id",
        "1L as quantity_on_hand",
        "1L as quantity_available",
    )
    contents = _pieces(
        lineitem, "N", "l_suppkey % 8", "cast(l_quantity as bigint) % 3"
    ).selectExpr(
        "1000000000000 + l_partkey * 8 + slot",
        "l_partkey",
        "cast(null as bigint)",
        "2",
        "3",
        "1",
        "370L",
        "2",
        f"{KIT_OF_PART.format('l_partkey')} * 100 + slot",
        "quantity",
        "quantity",
    )
    loose = _pieces(
        lineitem, "R", "l_linenumber % 2", "cast(l_quantity as bigint) % 5"
    ).selectExpr(
        "2000000000000 + l_partkey * 2 + slot",
        "l_partkey",
        "cast(null as bigint)",
        "1",
        "3",
        "1",
        "370L",
        "1",
        "10 + (l_partkey + slot) % 10",
        "quantity",
        "quantity",
    )
    return units.union(contents).union(loose)


def _bin(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "cast(n_nationkey as bigint) as id",
        "case when n_nationkey < 10 then 'G' when n_nationkey < 20 then 'R' else 'S' end "
        "|| cast(n_regionkey as string) as zone",
        f"{_digits('n_nationkey', 2)} as position",
        "'A' || cast(n_regionkey as string) as shelf",
    )


def _daily_snapshot(lineitem: DataFrame) -> DataFrame:
    return lineitem.where("l_returnflag = 'A'").selectExpr(
        f"{_digits('l_partkey', 11)} as prod_id",
        "case when l_linestatus = 'O' then 'E01' else 'E02' end as warehouse_id",
        "cast(l_quantity as bigint) as on_hand",
        "cast(l_quantity as bigint) % 7 as on_reserve",
        "cast(l_quantity as bigint) % 3 as unavailable",
        "date_add(date'2001-01-01', l_linenumber) as snapshot_dte",
    )


def from_star_schema(spark: SparkSession, sf_dir: str, **settings) -> Tables:
    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    derive = {
        "stock": lambda: _stock(read("part"), read("lineitem")),
        "product": lambda: _product(read("part")),
        "product_component": lambda: read("part").selectExpr(
            f"{KIT_ID} + {KIT_OF_PART.format('p_partkey')} as product_id",
            "p_partkey as component_product_id",
            "cast(1 + p_size % 3 as bigint) as quantity",
        ),
        "product_serial": lambda: _kit_serials(read("part")).selectExpr(
            "k * 100 + s as id", "100 + s as serial_number"
        ),
        "bin": lambda: _bin(read("nation")),
        "daily_snapshot": lambda: _daily_snapshot(read("lineitem")),
    }
    # A warehouse has these as tables; deriving them once stands in for that.
    return Tables(
        spark, lambda name: store(derive[name]()), **({"as_of": SNAPSHOT_DAY} | settings)
    )
