"""The kit standard: which components, and how many of each, make up a kit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekit.functions.skew import positioned
from rekit.operators.inventory import _not_excluded, _products, central_kits, unique_kits
from rekit.sources.tables import Tables


def standard_kits(tables: Tables, kits=None) -> DataFrame:
    """Numbers of the kits held in centralized inventory."""
    return central_kits(tables, kits).where(F.col("kit_number").isNotNull()).select(
        "kit_number"
    ).distinct()


def _bills(tables: Tables) -> DataFrame:
    return tables.product_component.select(
        F.col("product_id").alias("kit_id"), "component_product_id", "quantity"
    )


def _with_bill(kits: DataFrame, bills: DataFrame) -> DataFrame:
    """Kits with the rows of their bill of materials; a kit without one keeps a row.

    Not written as an outer join: of such a join Spark can split only the kits' side,
    whereas the many rows of a hot kit are on the other.
    """
    bare = kits.join(bills.select("kit_id").distinct(), "kit_id", "left_anti")
    return bills.join(kits, "kit_id").unionByName(bare, allowMissingColumns=True)


def kit_universe(tables: Tables) -> DataFrame:
    """Distinct (kit, component, quantity); a kit without components keeps a row."""
    # Units collapse to kits before the join, so it runs once per kit.
    kits = unique_kits(tables).withColumnRenamed("product_id", "kit_id")
    return _with_bill(kits, _bills(tables).distinct()).select(
        F.col("kit_id").alias("product_id"), "component_product_id", "quantity"
    )


def named_components(tables: Tables, products: DataFrame | None = None) -> DataFrame:
    """Names of components; ``products`` (product_id) restricts them."""
    named = _products(tables, "component")
    if products is not None:
        ids = products.withColumnRenamed("product_id", "component_id")
        named = named.join(ids, "component_id", "left_semi")
    return named.select(
        F.col("component_id").alias("component_product_id"),
        F.col("component_number").alias("component_product_number"),
        F.col("component_edi").alias("component_prod_id"),
        "component_description",
    )


def kit_components(
    tables: Tables, kits=None, component_details: DataFrame | None = None
) -> DataFrame:
    """The universe with names, without the excluded kits.

    ``component_details`` adds columns per component: a frame to use in place of the
    named components. Joining it here is cheaper than joining them to every kit row.
    """
    components = named_components(tables)
    details = []
    if component_details is not None:
        details = [c for c in component_details.columns if c not in components.columns]
        components = component_details
    kit_products = central_kits(tables, kits).where(_not_excluded("kit_number", tables.codes))
    return (
        _with_bill(kit_products, _bills(tables).distinct())
        .join(components, "component_product_id", "left")
        .select(
            F.col("kit_number").alias("kit_product_number"),
            "kit_edi",
            "kit_description",
            "component_product_number",
            "component_prod_id",
            "component_description",
            F.col("quantity").alias("component_quantity_in_kit"),
            *details,
        )
    )


def _standard_kits(tables: Tables, kits=None) -> DataFrame:
    return central_kits(tables, kits).where(F.col("kit_number").isNotNull())


def _listed_components(tables: Tables, kits=None) -> DataFrame:
    """Standard rows that have a component with a number."""
    components = _components(tables).where(F.col("component_number").isNotNull())
    return (
        _bills(tables)
        .join(_standard_kits(tables, kits), "kit_id")
        .join(components, "component_product_id")
    )


def _components(tables: Tables) -> DataFrame:
    return _products(tables, "component").withColumnRenamed("component_id", "component_product_id")


def kit_standard(tables: Tables, kits=None, ordered: bool = False) -> DataFrame:
    """The standard of all kits, or of the given ones.

    ``ordered`` sorts by kit and component number, NULLs last.
    """
    rows = _with_bill(_standard_kits(tables, kits), _bills(tables))
    standard = rows.join(_components(tables), "component_product_id", "left").select(
        "kit_number",
        "kit_edi",
        "kit_id",
        F.col("component_number").alias("product_number"),
        F.col("component_edi").alias("edi"),
        F.col("component_description").alias("description"),
        F.col("quantity").alias("component_qty_standard"),
    )
    if ordered:
        standard = standard.orderBy(
            F.asc_nulls_last("kit_number"), F.asc_nulls_last("product_number")
        )
    return standard


def kit_standard_in_order(tables: Tables, kits=None) -> DataFrame:
    """The standard with each row's ``position`` by kit and component number, NULLs last."""
    return positioned(
        kit_standard(tables, kits), F.asc_nulls_last("kit_number"), F.asc_nulls_last("product_number")
    )


def kit_standard_size(tables: Tables, kits=None) -> DataFrame:
    """Number of standard rows per kit (rows, not pieces)."""
    return (
        _with_bill(_standard_kits(tables, kits), _bills(tables))
        .groupBy("kit_number")
        .agg(F.count(F.lit(1)).alias("total_pieces"))
    )


def build_standard(tables: Tables, kits=None) -> DataFrame:
    """The standard as reassembly uses it: one row per kit and component product.

    Repeated rows of a component are added up; ``standard_rows`` tells how many
    there were. Rows without a component are left out. One unknown quantity makes
    the sum unknown.
    """
    quantity = F.col("quantity")
    return (
        _listed_components(tables, kits)
        .groupBy(
            "kit_number", "component_product_id", F.col("component_number").alias("component")
        )
        .agg(
            F.when(F.count(quantity) == F.count(F.lit(1)), F.sum(quantity)).alias("std_qty"),
            F.count(F.lit(1)).alias("standard_rows"),
        )
    )


def kit_standard_map(tables: Tables, kits=None) -> DataFrame:
    """Entries of the map component -> (edi, description, quantity), with the kit's
    number of standard rows beside them.

    A map has one entry per component: repeated rows are added up and the
    smallest edi and description in byte order are shown. One unknown quantity makes the
    sum unknown, as in the standard that a rebuild uses.
    """
    quantity = F.col("quantity")
    entries = (
        _listed_components(tables, kits)
        .groupBy("kit_number", F.col("component_number").alias("component"))
        .agg(
            F.min("component_edi").alias("edi"),
            F.min("component_description").alias("description"),
            F.when(F.count(quantity) == F.count(F.lit(1)), F.sum(quantity)).alias(
                "component_qty_standard"
            ),
        )
    )
    return entries.join(kit_standard_size(tables, kits), "kit_number")
