"""Writers for the results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _writer(df: DataFrame, kit_column: str, per_kit: bool, mode: str):
    # Rebalance keeps a kit's rows together, splits kits too big for one file and
    # merges small ones, so the number of files follows the data.
    writer = df.hint("rebalance", kit_column).write.mode(mode)
    return writer.partitionBy(kit_column) if per_kit else writer


def write_json(
    df: DataFrame, path: str, kit_column="kit_number", per_kit=False, mode="overwrite"
) -> None:
    """JSON lines. ``per_kit`` writes a folder per kit: for a handful of kits only."""
    _writer(df, kit_column, per_kit, mode).option("ignoreNullFields", False).json(path)


def write_csv(
    df: DataFrame, path: str, kit_column="kit_number", per_kit=False, mode="overwrite"
) -> None:
    _writer(df, kit_column, per_kit, mode).option("header", True).csv(path)


def write_parquet(
    df: DataFrame, path: str, kit_column="kit_number", per_kit=False, mode="overwrite"
) -> None:
    _writer(df, kit_column, per_kit, mode).parquet(path)
