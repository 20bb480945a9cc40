"""Schemas of the six warehouse tables and of the request input."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(*columns: tuple) -> StructType:
    return StructType([StructField(name, kind(), nullable) for name, kind, nullable in columns])


STOCK = _struct(
    ("id", LongType, False),
    ("product_id", LongType, False),
    ("serial_id", LongType, True),
    ("stock_type", IntegerType, False),
    ("inventory_type", IntegerType, False),
    ("location_type", IntegerType, False),
    ("location_id", LongType, False),
    ("container_type", IntegerType, True),
    ("container_id", LongType, True),
    ("quantity_on_hand", LongType, True),
    ("quantity_available", LongType, True),
)
PRODUCT = _struct(
    ("id", LongType, False),
    ("product_number", StringType, True),
    ("edi_number", StringType, True),
    ("description", StringType, True),
)
PRODUCT_COMPONENT = _struct(
    ("product_id", LongType, False),
    ("component_product_id", LongType, False),
    ("quantity", LongType, True),
)
PRODUCT_SERIAL = _struct(
    ("id", LongType, False),
    ("serial_number", LongType, True),
)
BIN = _struct(
    ("id", LongType, False),
    ("zone", StringType, True),
    ("position", StringType, True),
    ("shelf", StringType, True),
)
DAILY_SNAPSHOT = _struct(
    ("prod_id", StringType, False),
    ("warehouse_id", StringType, False),
    ("on_hand", LongType, True),
    ("on_reserve", LongType, True),
    ("unavailable", LongType, True),
    # last: this is the partition column on disk
    ("snapshot_dte", DateType, False),
)
REQUESTS = _struct(
    ("kit_number", StringType, False),
    ("serial_number", StringType, False),
    ("build_pos", LongType, False),
)

SCHEMAS = {
    "stock": STOCK,
    "product": PRODUCT,
    "product_component": PRODUCT_COMPONENT,
    "product_serial": PRODUCT_SERIAL,
    "bin": BIN,
    "daily_snapshot": DAILY_SNAPSHOT,
}
