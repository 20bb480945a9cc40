"""Which serials to break out, and in which order to rebuild them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rekit.functions.skew import rank_in_group
from rekit.operators.inventory import reported_units
from rekit.session import store
from rekit.sources.schema import REQUESTS
from rekit.sources.tables import Tables


def requests_for(spark: SparkSession, kit_number: str, serials) -> DataFrame:
    """The requests of one call: a kit and its serials in the order given."""
    rows = [(kit_number, str(serial), pos) for pos, serial in enumerate(serials, start=1)]
    return spark.createDataFrame(rows, REQUESTS)


def read_requests(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A request file with kit_number, serial_number and build_pos."""
    reader = spark.read.schema(REQUESTS).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def split_requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests.

    A serial that is not a whole number is rejected. A serial requested twice
    counts once, at its first place; places are then renumbered 1, 2, ... per kit.
    """
    serial = F.expr("try_cast(serial_number as bigint)")
    readable = serial.isNotNull() & F.col("kit_number").isNotNull() & F.col("build_pos").isNotNull()
    first = (
        raw.where(readable)
        .groupBy("kit_number", serial.alias("serial_number"))
        .agg(F.min(F.col("build_pos").cast("long")).alias("_place"))
    )
    accepted = rank_in_group(store(first), "kit_number", "_place", "build_pos").select(
        "kit_number", "serial_number", "build_pos"
    )
    return accepted, raw.where(~readable)


def _serials(units: DataFrame) -> DataFrame:
    return (
        units.where(F.col("serial_number").isNotNull())
        .select("kit_number", "serial_number")
        .distinct()
    )


def on_site_serials(tables: Tables, kits=None) -> DataFrame:
    """All serials of the reported kits that are on site, valid or not."""
    return _serials(reported_units(tables, kits))


def invalid_serials(tables: Tables, kits=None) -> DataFrame:
    """The invalid ones among them: those a rebuild is normally asked for."""
    units = reported_units(tables, kits)
    return _serials(units.where(F.col("stock_type") == tables.codes.invalid_kit))


def in_serial_order(serials: DataFrame) -> DataFrame:
    """Requests that build a kit's serials in ascending order."""
    return rank_in_group(store(serials), "kit_number", "serial_number", "build_pos").select(
        "kit_number", "serial_number", "build_pos"
    )


def invalid_serial_requests(tables: Tables, kits=None) -> DataFrame:
    return in_serial_order(invalid_serials(tables, kits))
