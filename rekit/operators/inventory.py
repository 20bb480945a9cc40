"""What is in stock: kit units and their bins, kit contents, loose pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekit.functions.expressions import bin_label, invalid_share, net_available
from rekit.sources.tables import InventoryCodes, Tables


def _kit_unit(codes: InventoryCodes) -> Column:
    return F.col("stock_type").isin(codes.valid_kit, codes.invalid_kit)


def _on_site(codes: InventoryCodes) -> Column:
    return (F.col("location_type") == codes.location_type) & (
        F.col("location_id") == codes.location_id
    )


def _centralized(codes: InventoryCodes) -> Column:
    return F.col("inventory_type") == codes.centralized


def _in_bin(rows: DataFrame, tables: Tables, zone: str) -> DataFrame:
    """Keep rows stored in a bin of the zone and add the bin's label."""
    bins = tables.bin.where(F.col("zone").startswith(zone)).select(
        F.col("id").alias("container_id"), bin_label().alias("bin_label")
    )
    return rows.where(F.col("container_type") == tables.codes.in_bin).join(bins, "container_id")


def _products(tables: Tables, role: str) -> DataFrame:
    """The product table with its columns named after the role it plays."""
    return tables.product.select(
        F.col("id").alias(f"{role}_id"),
        F.col("product_number").alias(f"{role}_number"),
        F.col("edi_number").alias(f"{role}_edi"),
        F.col("description").alias(f"{role}_description"),
    )


def only_kits(df: DataFrame, column: str, kits) -> DataFrame:
    """Restrict to kit numbers: a list, a frame with ``kit_number``, or None for all."""
    if kits is None:
        return df
    if isinstance(kits, DataFrame):
        wanted = kits.select(F.col("kit_number").alias(column))
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(kits)))


def kit_units(tables: Tables, kits=None) -> DataFrame:
    """Stock rows of kits, valid or not and wherever they are, with their names.

    Everything about kits and serials starts from these, so the stock table is read
    once for all of it. Kits given as a list of numbers have rows of their own: their
    products restrict the scan of the stock table.
    """
    codes = tables.codes
    some = kits is not None and not isinstance(kits, DataFrame)

    def build():
        stock = tables.stock.where(_kit_unit(codes))
        if some:
            products = tables.product.where(F.col("product_number").isin(list(kits)))
            ids = products.select(F.col("id").alias("product_id"))
            stock = stock.join(ids, "product_id", "left_semi")
        units = stock.select(
            F.col("id").alias("unit_id"),
            F.col("product_id").alias("kit_id"),
            "serial_id",
            "stock_type",
            "inventory_type",
            "location_type",
            "location_id",
            F.when(F.col("container_type") == codes.in_bin, F.col("container_id")).alias("bin_id"),
            "quantity_on_hand",
        )
        bins = tables.bin.select(F.col("id").alias("bin_id"), "zone", bin_label().alias("kit_bin"))
        return (
            units.join(bins, "bin_id", "left")
            .join(_products(tables, "kit"), "kit_id", "left")
            .join(_serials(tables), "serial_id", "left")
        )

    name = "kit_units" + (f":{sorted(map(str, kits))}" if some else "")
    return tables.once(name, build)


def _serials(tables: Tables) -> DataFrame:
    return tables.product_serial.select(F.col("id").alias("serial_id"), "serial_number")


def _central_units(tables: Tables, kits=None) -> DataFrame:
    return kit_units(tables, kits).where(_centralized(tables.codes))


def _site_units(tables: Tables, kits=None) -> DataFrame:
    """Kit units on site in a kit bin, of any inventory type."""
    codes = tables.codes
    on_site = _on_site(codes) & F.col("zone").startswith(codes.kit_zone)
    return only_kits(kit_units(tables, kits).where(on_site), "kit_number", kits)


def unique_kits(tables: Tables) -> DataFrame:
    """Products held as kit units in centralized inventory, at any location."""
    return _central_units(tables).select(F.col("kit_id").alias("product_id")).distinct()


def central_kits(tables: Tables, kits=None) -> DataFrame:
    """The same with their names: kit_id, kit_number, kit_edi, kit_description."""
    return only_kits(
        _central_units(tables, kits).select("kit_id", "kit_number", "kit_edi", "kit_description"),
        "kit_number",
        kits,
    ).distinct()


def loose_availability(tables: Tables, products: DataFrame | None = None) -> DataFrame:
    """Available loose pieces per component and bin of the loose-piece zone.

    ``products`` (product_id) restricts it before anything is summed up.
    """
    codes = tables.codes
    pieces = tables.stock.where(
        (F.col("stock_type") == codes.loose_piece)
        & _centralized(codes)
        & _on_site(codes)
        & (F.col("quantity_available") > 0)
    )
    if products is not None:
        pieces = pieces.join(products, "product_id", "left_semi")
    # Summed per product id first: names are looked up once per product and bin.
    per_id = (
        _in_bin(pieces, tables, codes.loose_zone)
        .groupBy(F.col("product_id").alias("product_id"), "bin_label")
        .agg(F.sum("quantity_available").alias("quantity"))
    )
    return (
        per_id.join(_products(tables, "product"), "product_id", "left")
        .groupBy(
            "product_number",
            F.col("product_edi").alias("edi_number"),
            F.col("bin_label").alias("component_bin"),
        )
        .agg(F.sum("quantity").alias("qty_avail_sh"))
    )


def _validity_sums(tables: Tables, *extra: str, kits=None) -> DataFrame:
    """On-hand sums of valid and invalid units; NULL where a status is absent."""
    codes = tables.codes
    stock_type, on_hand = F.col("stock_type"), F.col("quantity_on_hand")
    return (
        _site_units(tables, kits)
        .where(_centralized(codes))
        .groupBy("kit_number", "kit_edi", "kit_description", *extra)
        .agg(
            F.sum(F.when(stock_type == codes.valid_kit, on_hand)).alias("valid"),
            F.sum(F.when(stock_type == codes.invalid_kit, on_hand)).alias("invalid"),
        )
    )


def kit_validity_by_type(tables: Tables) -> DataFrame:
    """One row per kit and unit status, the other status' column being NULL."""
    return _validity_sums(tables, "stock_type").select(
        F.col("kit_number").alias("product_number"),
        F.col("kit_edi").alias("edi_number"),
        F.col("kit_description").alias("description"),
        "valid",
        "invalid",
    )


def kit_percent_invalid(tables: Tables, kits=None) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _validity_sums(tables, kits=kits).select(
        F.col("kit_number").alias("kit_prod_number"),
        "kit_edi",
        "kit_description",
        F.coalesce("valid", zero).alias("valid"),
        F.coalesce("invalid", zero).alias("invalid"),
        invalid_share("valid", "invalid").alias("percent_invalid"),
    )


def serial_contents(tables: Tables, kits=None) -> DataFrame:
    """Pieces held by each kit serial, per component.

    A piece's stock row points at the stock row that contains it. Only rows that
    do contain something get their names looked up.
    """
    codes = tables.codes
    # Summed by ids before any name is looked up; the pieces are read once.
    pieces = (
        tables.stock.where(
            (F.col("stock_type") == codes.kit_content)
            & (F.col("container_type") == codes.in_stock_row)
            & _on_site(codes)
        )
        .groupBy("container_id", "product_id")
        .agg(F.sum("quantity_available").alias("quantity_available"))
    )
    bins = tables.bin.select(F.col("id").alias("bin_id"), bin_label().alias("kit_bin"))
    kit_products = only_kits(
        _products(tables, "kit").where(F.col("kit_number").isNotNull()), "kit_number", kits
    )
    holders = tables.stock.select(
        F.col("id").alias("container_id"),
        F.col("product_id").alias("kit_id"),
        "serial_id",
        F.when(F.col("container_type") == codes.in_bin, F.col("container_id")).alias("bin_id"),
    ).join(kit_products, "kit_id")
    components = _products(tables, "component").withColumnRenamed("component_id", "product_id")
    return (
        pieces.join(holders, "container_id")
        .join(_serials(tables), "serial_id", "left")
        .join(bins, "bin_id", "left")
        .join(components, "product_id", "left")
        .groupBy(
            F.col("kit_number").alias("kit_prod_number"),
            "kit_edi",
            "kit_description",
            "serial_number",
            "kit_bin",
            F.col("component_number").alias("component_product_number"),
            "component_edi",
            "component_description",
        )
        .agg(F.sum("quantity_available").alias("quantity_available"))
    )


def warehouse_availability(tables: Tables, products: DataFrame | None = None) -> DataFrame:
    """Net pieces per product in the second warehouse, on the snapshot day.

    ``products`` (prod_id) restricts it before anything is summed up.
    """
    snapshot = tables.daily_snapshot.where(
        (F.col("snapshot_dte") == tables.snapshot_date())
        & (F.col("warehouse_id") == tables.codes.second_warehouse)
    )
    if products is not None:
        snapshot = snapshot.join(products, "prod_id", "left_semi")
    return (
        snapshot.groupBy("prod_id")
        .agg(F.sum(net_available()).alias("qty_avail_e01"))
    )


def kit_serials(tables: Tables, kits=None) -> DataFrame:
    """Kit serials on site in a kit bin."""
    return (
        _site_units(tables, kits)
        .where(_centralized(tables.codes))
        .select(F.col("kit_number").alias("kit_product_number"), "kit_edi", "serial_number")
        .distinct()
    )


def kit_bins(tables: Tables, kits=None) -> DataFrame:
    """Kit bins in which units of a kit are stored."""
    return (
        _site_units(tables, kits)
        .where(F.col("kit_number").isNotNull())
        .select(
            F.col("kit_number").alias("kit_prod_number"), "kit_edi", "kit_description", "kit_bin"
        )
        .distinct()
    )


def _not_excluded(column: str, codes: InventoryCodes) -> Column:
    return ~F.col(column).startswith(codes.excluded_prefix)


def reported_kits(tables: Tables, kits=None) -> DataFrame:
    """Numbers of the kits the report covers: not excluded, and with a kit bin."""
    numbers = (
        _site_units(tables, kits)
        .where(F.col("kit_bin").isNotNull() & _not_excluded("kit_number", tables.codes))
        .select("kit_number")
    )
    return numbers.distinct()


def reported_units(tables: Tables, kits=None) -> DataFrame:
    """Stock rows of the serials the report covers.

    Columns: unit_id, kit_number, serial_number, stock_type, kit_bin.
    """
    return (
        _site_units(tables, kits)
        .where(_centralized(tables.codes))
        .select("unit_id", "kit_number", "serial_number", "stock_type", "kit_bin")
        .join(reported_kits(tables, kits), "kit_number", "left_semi")
    )
