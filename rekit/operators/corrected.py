"""The breakout without repeated rows: one row per serial and component.

Differences from the report: pieces are matched by product id, the kit bin is the
serial's own, and loose pieces are totalled over bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekit.functions.skew import heavy_keys, joined_rows, spread, tile_rows
from rekit.operators.inventory import (
    _on_site,
    central_kits,
    kit_percent_invalid,
    loose_availability,
    reported_units,
    warehouse_availability,
)
from rekit.operators.standard import build_standard
from rekit.sources.tables import Tables


def serial_components(tables: Tables, units: DataFrame) -> DataFrame:
    """Pieces per (kit_number, serial_number, component_product_id) in the given units
    (unit_id, kit_number, serial_number)."""
    codes = tables.codes
    pieces = tables.stock.where(
        (F.col("stock_type") == codes.kit_content)
        & (F.col("container_type") == codes.in_stock_row)
        & _on_site(codes)
    ).select(
        F.col("container_id").alias("unit_id"),
        F.col("product_id").alias("component_product_id"),
        "quantity_available",
    )
    return (
        pieces.join(units.select("unit_id", "kit_number", "serial_number"), "unit_id")
        .groupBy("kit_number", "serial_number", "component_product_id")
        .agg(F.coalesce(F.sum("quantity_available"), F.lit(0).cast("long")).alias("quantity"))
    )


def _requested_units(tables: Tables, requests: DataFrame) -> DataFrame:
    units = reported_units(tables, requests.select("kit_number").distinct())
    return units.join(
        requests.select("kit_number", "serial_number"),
        ["kit_number", "serial_number"],
        "left_semi",
    )


def kit_breakout_corrected(tables: Tables, kits=None) -> DataFrame:
    """One row per reported serial and component of its standard.

    ``component_bin`` is the bin with most loose pieces (ties: last label in byte
    order), ``component_bins`` how many bins hold some. A serial kept in several
    bins shows the first label in byte order.
    """
    key = "kit_number"
    zero = F.lit(0).cast("long")
    units = tables.shared(
        reported_units(tables, kits).where(F.col("serial_number").isNotNull())
    )
    serials = units.groupBy(key, "serial_number").agg(F.min("kit_bin").alias("kit_bin"))
    standard = tables.shared(build_standard(tables, kits))
    contents = tables.shared(serial_components(tables, units))

    # Missing pieces: what the whole kit wants, less what the serial holds of it.
    whole_kit = standard.groupBy(key).agg(F.sum("std_qty").alias("wanted"))
    held = (
        contents.join(standard.where(F.col("std_qty").isNotNull()), [key, "component_product_id"])
        .groupBy(key, "serial_number")
        .agg(F.sum("quantity").alias("held"))
    )
    serials = (
        serials.join(whole_kit, key)
        .join(held, [key, "serial_number"], "left")
        .withColumn("pieces_missing", F.col("wanted") - F.coalesce("held", zero))
        .drop("wanted", "held")
    )

    loose = (
        loose_availability(tables)
        .groupBy("product_number", "edi_number")
        .agg(
            F.sum("qty_avail_sh").alias("qty_avail_sh"),
            F.max_by("component_bin", F.struct("qty_avail_sh", "component_bin")).alias(
                "component_bin"
            ),
            F.count(F.lit(1)).alias("component_bins"),
        )
        .withColumnsRenamed(
            {"product_number": "component_product_number", "edi_number": "component_prod_id"}
        )
    )
    second = warehouse_availability(tables).withColumnRenamed("prod_id", "component_prod_id")
    names = (
        tables.product.select(
            F.col("id").alias("component_product_id"),
            F.col("edi_number").alias("component_prod_id"),
            F.col("description").alias("component_description"),
        )
    )
    kit_names = (
        central_kits(tables, kits)
        .groupBy(key)
        .agg(F.min("kit_edi").alias("kit_edi"), F.min("kit_description").alias("kit_description"))
    )
    shares = (
        kit_percent_invalid(tables)
        .groupBy(F.col("kit_prod_number").alias(key), "kit_edi")
        .agg(F.max("percent_invalid").alias("percent_invalid"))
    )
    components = (
        standard.join(names, "component_product_id")
        .withColumnRenamed("component", "component_product_number")
        .join(loose, ["component_product_number", "component_prod_id"], "left")
        .join(second, "component_prod_id", "left")
        .join(kit_names.join(shares, [key, "kit_edi"], "left"), key)
    )

    rows = F.count(F.lit(1))
    counts = (
        units.groupBy(key).agg(rows.alias("left_rows")),
        standard.groupBy(key).agg(rows.alias("right_rows")),
        key,
    )
    heavy = tables.shared(heavy_keys(*counts))
    serials = tile_rows(serials, heavy, key, "left", "serial_number")
    serials = spread(serials, joined_rows(*counts), key, "_lt", "_rt")
    return (
        serials.join(
            tile_rows(components, heavy, key, "right", "component_product_id"),
            [key, "_lt", "_rt"],
        )
        .join(contents, [key, "serial_number", "component_product_id"], "left")
        .select(
            F.col(key).alias("kit_product_number"),
            "kit_edi",
            "kit_description",
            "serial_number",
            "kit_bin",
            "component_product_number",
            "component_prod_id",
            "component_description",
            F.col("std_qty").alias("component_quantity_in_kit"),
            F.coalesce("quantity", zero).alias("qty_in_kit"),
            "qty_avail_sh",
            "component_bin",
            "component_bins",
            "qty_avail_e01",
            "percent_invalid",
            "pieces_missing",
            F.greatest(F.col("std_qty") - F.coalesce("quantity", zero), zero).alias("shortage"),
        )
    )


def serial_diff_corrected(tables: Tables, requests: DataFrame) -> DataFrame:
    """Per requested serial: missing pieces (signed), components it holds none of, and
    the shortage, in which a surplus of one component does not offset another."""
    zero = F.lit(0).cast("long")
    kits = requests.select("kit_number").distinct()
    standard = tables.shared(build_standard(tables, kits))
    whole_kit = standard.groupBy("kit_number").agg(
        F.coalesce(F.sum("std_qty"), zero).alias("wanted"),
        F.coalesce(F.sum(F.greatest("std_qty", zero)), zero).alias("wanted_positive"),
        F.count(F.lit(1)).alias("components"),
    )
    quantity, wanted = F.col("quantity"), F.col("std_qty")
    held = (
        serial_components(tables, _requested_units(tables, requests))
        .join(standard, ["kit_number", "component_product_id"])
        .groupBy("kit_number", "serial_number")
        .agg(
            F.sum(F.when(wanted.isNotNull(), quantity)).alias("held"),
            F.sum(
                F.when(
                    wanted.isNotNull(),
                    F.greatest(wanted, zero) - F.greatest(wanted - quantity, zero),
                )
            ).alias("covered"),
            F.count(F.when(quantity != 0, 1)).alias("present"),
        )
    )
    return (
        requests.select("kit_number", "serial_number")
        .join(whole_kit, "kit_number", "left")
        .join(held, ["kit_number", "serial_number"], "left")
        .select(
            "kit_number",
            "serial_number",
            (F.coalesce("wanted", zero) - F.coalesce("held", zero)).alias("pieces_missing"),
            (F.coalesce("components", zero) - F.coalesce("present", zero)).alias(
                "components_missing"
            ),
            (F.coalesce("wanted_positive", zero) - F.coalesce("covered", zero)).alias("shortage"),
        )
    )


def requested_contents_corrected(tables: Tables, requests: DataFrame) -> DataFrame:
    """Pieces pooled from the requested serials, each counted once.

    Columns: kit_number, component_product_id, quantity.
    """
    units = _requested_units(tables, requests)
    return (
        serial_components(tables, units)
        .groupBy("kit_number", "component_product_id")
        .agg(F.sum("quantity").alias("quantity"))
    )
