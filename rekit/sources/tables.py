"""The six source tables and the ways to load them."""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rekit.session import store
from rekit.sources.schema import SCHEMAS


@dataclass(frozen=True)
class InventoryCodes:
    """Domain codes of the warehouse. Fixed values; results depend on them."""

    centralized: int = 3  # inventory_type
    loose_piece: int = 1  # stock_type
    kit_content: int = 2
    valid_kit: int = 3
    invalid_kit: int = 4
    location_type: int = 1
    location_id: int = 370
    in_bin: int = 1  # container_type
    in_stock_row: int = 2
    loose_zone: str = "R"
    kit_zone: str = "G"
    second_warehouse: str = "E01"
    excluded_prefix: str = "ZPB"


#: Tables that grow with the business; the others describe products and places.
GROWING = ("stock", "product_serial", "daily_snapshot")


class Tables:
    """The six tables; each is loaded when it is first asked for.

    ``as_of`` is the snapshot day, today by default. With ``storing`` off nothing is
    written while a plan is built, at the price of computing shared parts repeatedly.
    """

    def __init__(
        self,
        spark: SparkSession,
        load: Callable[[str], DataFrame],
        codes: InventoryCodes = InventoryCodes(),
        as_of: datetime.date | None = None,
        storing: bool = True,
    ):
        self.spark, self.codes, self.as_of, self.storing = spark, codes, as_of, storing
        self._load = load
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def stock(self) -> DataFrame:
        return self._load("stock")

    @cached_property
    def product(self) -> DataFrame:
        return self._load("product")

    @cached_property
    def product_component(self) -> DataFrame:
        return self._load("product_component")

    @cached_property
    def product_serial(self) -> DataFrame:
        return self._load("product_serial")

    @cached_property
    def bin(self) -> DataFrame:
        return self._load("bin")

    @cached_property
    def daily_snapshot(self) -> DataFrame:
        return self._load("daily_snapshot")

    def with_settings(self, **changes) -> Tables:
        """The same tables with another ``as_of``, ``codes`` or ``storing``."""
        settings = {"codes": self.codes, "as_of": self.as_of, "storing": self.storing}
        return Tables(self.spark, lambda name: getattr(self, name), **(settings | changes))

    def shared(self, df: DataFrame) -> DataFrame:
        """A frame that several parts of a plan read."""
        return store(df) if self.storing else df

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame derived from the tables alone, shared by all reports on them."""
        if name not in self._made:
            self._made[name] = self.shared(build())
        return self._made[name]

    def snapshot_date(self) -> Column:
        return F.current_date() if self.as_of is None else F.lit(self.as_of)


def read_parquet(spark: SparkSession, root: str, **settings) -> Tables:
    """Load ``root/<table>``; the snapshot may be laid out by ``snapshot_dte=``."""
    return Tables(
        spark, lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}"), **settings
    )


def write_parquet(tables: Tables, root: str) -> None:
    """Store the tables the way ``read_parquet`` and partition pruning want them."""
    for name in SCHEMAS:
        frame = getattr(tables, name)
        if name == "daily_snapshot":
            # rebalance: one writer per day, but a big day is split over several
            frame.hint("rebalance", "snapshot_dte").write.mode("overwrite").partitionBy(
                "snapshot_dte"
            ).parquet(f"{root}/{name}")
        else:
            frame.write.mode("overwrite").parquet(f"{root}/{name}")


def jdbc_options(table: str, split: dict | None = None, **options) -> dict:
    """Options of a JDBC read. Connection data come from the caller or from
    REKIT_JDBC_URL / REKIT_JDBC_USER / REKIT_JDBC_PASSWORD, never from code.

    ``split`` = ``{"column", "lower", "upper", "partitions"}`` reads a table in
    parallel ranges; without it one task reads everything.
    """
    merged = {
        key: os.environ[variable]
        for key, variable in (
            ("url", "REKIT_JDBC_URL"),
            ("user", "REKIT_JDBC_USER"),
            ("password", "REKIT_JDBC_PASSWORD"),
        )
        if variable in os.environ
    }
    merged.update(options)
    if "url" not in merged:
        raise ValueError("no JDBC url: pass url= or set REKIT_JDBC_URL")
    merged["dbtable"] = table
    merged.setdefault("fetchsize", "10000")
    if split:
        merged.update(
            partitionColumn=split["column"],
            lowerBound=str(split["lower"]),
            upperBound=str(split["upper"]),
            numPartitions=str(split["partitions"]),
        )
    return merged


def read_jdbc(
    spark: SparkSession,
    names: dict[str, str],
    splits: dict[str, dict] | None = None,
    renames: dict[str, dict[str, str]] | None = None,
    settings: dict | None = None,
    **options,
) -> Tables:
    """Load the tables from a relational database.

    ``names`` maps our table names to the database's; ``renames`` maps database
    column names to ours per table. ``splits`` must name the growing tables, which one
    task could not read. Each table is read once, when it is first asked for, and stored,
    so all parts of a report see the same rows.
    """
    if missing := sorted(set(GROWING) - set(splits or {})):
        raise ValueError(f"say how to split {', '.join(missing)}")

    def load(name):
        reader = spark.read.format("jdbc").options(
            **jdbc_options(names[name], (splits or {}).get(name), **options)
        )
        frame = reader.load().withColumnsRenamed((renames or {}).get(name, {}))
        return store(frame.select([F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]]))

    return Tables(spark, load, **(settings or {}))
