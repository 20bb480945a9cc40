"""The breakout report: every component of every kit serial, as reported.

The report repeats a row for every bin that holds loose pieces of the component
and for every bin that holds units of the kit, and its missing-piece count adds
up these repeated rows. ``rekit.operators.corrected`` has the counts without the
repetition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekit.functions.skew import (
    BOX,
    box_rows,
    heavy_boxes,
    heavy_keys,
    in_pieces,
    joined_rows,
    positioned,
    spread,
    tile_rows,
    total_rows,
)
from rekit.operators.inventory import (
    central_kits,
    kit_bins,
    kit_percent_invalid,
    kit_serials,
    loose_availability,
    reported_kits,
    serial_contents,
    warehouse_availability,
)
from rekit.operators.standard import (
    kit_components,
    kit_standard_size,
    named_components,
    standard_kits,
)
from rekit.sources.tables import Tables

REPORT_COLUMNS = [
    "kit_product_number",
    "kit_edi",
    "kit_description",
    "serial_number",
    "kit_bin",
    "component_product_number",
    "component_prod_id",
    "component_description",
    "component_quantity_in_kit",
    "qty_in_kit",
    "qty_avail_sh",
    "component_bin",
    "qty_avail_e01",
    "percent_invalid",
    "pieces_missing",
]


def serial_kit_grid(tables: Tables, kits=None) -> DataFrame:
    """Every component of a kit for every serial of it; kits without a serial on
    site keep one row per component."""
    key = "kit_product_number"
    components = kit_components(tables, kits)
    serials = kit_serials(tables, kits).select(key, "serial_number")
    bare = (
        standard_kits(tables, kits)
        .withColumnRenamed("kit_number", key)
        .join(serials.select(key).distinct(), key, "left_anti")
    )
    rows = F.count(F.lit(1))
    counts = (
        tables.shared(serials.groupBy(key).agg(rows.alias("left_rows"))),
        tables.shared(
            kit_standard_size(tables, kits).select(
                F.col("kit_number").alias(key),
                F.col("total_pieces").alias("right_rows"),
            )
        ),
        key,
    )
    heavy = tables.shared(heavy_keys(*counts))
    tiled = tile_rows(
        serials.unionByName(bare, allowMissingColumns=True), heavy, key, "left", "serial_number"
    )
    # An inner join: a copied row that meets nothing in one tile must not show up.
    return (
        spread(tiled, joined_rows(*counts), key, "_lt", "_rt")
        .join(
            tile_rows(
                components,
                heavy,
                key,
                "right",
                "component_product_number",
                "component_prod_id",
                "component_description",
                "component_quantity_in_kit",
            ),
            [key, "_lt", "_rt"],
        )
        .select(
            key,
            "kit_edi",
            "kit_description",
            "serial_number",
            "component_product_number",
            "component_prod_id",
            "component_description",
            "component_quantity_in_kit",
        )
    )


def _shown_bins(tables: Tables, kits=None) -> DataFrame:
    return kit_bins(tables, kits).where(F.col("kit_bin").isNotNull())


def _component_ids(tables: Tables, kits) -> DataFrame | None:
    """Products that the bills of the given kits name; None for all kits."""
    if kits is None:
        return None
    bills = tables.product_component.withColumnRenamed("product_id", "kit_id")
    return tables.shared(
        bills.join(central_kits(tables, kits), "kit_id", "left_semi")
        .select(F.col("component_product_id").alias("product_id"))
        .distinct()
    )


def _repetition(tables: Tables, kits=None) -> DataFrame:
    """Per kit, component edi and component number: how often the report repeats the
    component for one serial row, and the standard quantities added up that way.

    Columns: kit_product_number, component_prod_id, component_product_number,
    times (rows), known (rows with a standard quantity), wanted (their quantities).
    """
    rows = F.count(F.lit(1))
    loose = (
        loose_availability(tables, _component_ids(tables, kits))
        .groupBy(
            F.col("product_number").alias("component_product_number"),
            F.col("edi_number").alias("component_prod_id"),
        )
        .agg(rows.alias("loose_rows"))
    )
    percent = (
        kit_percent_invalid(tables, kits)
        .groupBy(F.col("kit_prod_number").alias("kit_product_number"), "kit_edi")
        .agg(rows.alias("percent_rows"))
    )
    bins = (
        _shown_bins(tables, kits)
        .groupBy(F.col("kit_prod_number").alias("kit_product_number"))
        .agg(rows.alias("bin_rows"))
    )
    one = F.lit(1).cast("long")
    standard = F.col("component_quantity_in_kit")
    repeated = (
        kit_components(tables, kits)
        .join(bins, "kit_product_number")
        .join(percent, ["kit_product_number", "kit_edi"], "left")
        .join(loose, ["component_product_number", "component_prod_id"], "left")
        .withColumn(
            "times",
            F.col("bin_rows") * F.coalesce("percent_rows", one) * F.coalesce("loose_rows", one),
        )
    )
    return repeated.groupBy(
        "kit_product_number", "component_prod_id", "component_product_number"
    ).agg(
        F.sum("times").alias("times"),
        F.sum(F.when(standard.isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * standard).alias("wanted"),
    )


def _held(contents: DataFrame) -> DataFrame:
    """Contents per kit serial and component edi.

    ``matches`` counts the content rows the report joins to one grid row, ``filled``
    those with a quantity other than zero.
    """
    quantity = F.col("quantity_available")
    return contents.groupBy("kit_product_number", "serial_number", "component_prod_id").agg(
        F.coalesce(F.sum(quantity), F.lit(0).cast("long")).alias("quantity"),
        F.count(F.lit(1)).alias("matches"),
        F.count(F.when(quantity != 0, 1)).alias("filled"),
    )


def _report_serials(tables: Tables, kits=None, requests: DataFrame | None = None) -> DataFrame:
    """Serials of the report, all or only the requested ones, with the number of
    rows (``serial_rows``) each kit row is repeated for a serial.

    A reported kit none of whose units is a centralized one on site has a row with
    serial NULL.
    """
    covered = reported_kits(tables, kits).join(
        standard_kits(tables, kits), "kit_number", "left_semi"
    )
    present = kit_serials(tables, kits).withColumnRenamed("kit_product_number", "kit_number")
    rows = present.join(covered, "kit_number", "left_semi").select("kit_number", "serial_number")
    if requests is None:
        bare = covered.join(present.select("kit_number").distinct(), "kit_number", "left_anti")
        rows = rows.unionByName(bare, allowMissingColumns=True)
    else:
        rows = rows.join(requests, ["kit_number", "serial_number"], "left_semi")
    return rows.groupBy("kit_number", "serial_number").agg(F.count(F.lit(1)).alias("serial_rows"))


def _report_components(tables: Tables, kits=None) -> DataFrame:
    """Component rows of the report as far as they do not depend on the serial.

    The report has a row per component, bin with loose pieces and kit bin; here the bins of
    either kind are lists, ``loose`` and ``bins``, in pieces of bounded size, so that what they
    multiply to is never shuffled.
    """
    wanted = _component_ids(tables, kits)
    loose = loose_availability(tables, wanted).withColumnsRenamed(
        {"product_number": "component_product_number", "edi_number": "component_prod_id"}
    )
    named = named_components(tables, wanted)
    edis = None if wanted is None else named.select(F.col("component_prod_id").alias("prod_id"))
    second = warehouse_availability(tables, edis).withColumnRenamed("prod_id", "component_prod_id")
    name = ["component_product_number", "component_prod_id"]
    in_bins = F.struct("component_bin", "qty_avail_sh")
    details = (
        named
        .join(second, "component_prod_id", "left")
        .join(in_pieces(loose, name, in_bins, ["component_bin"], "loose"), name, "left")
    )
    percent = kit_percent_invalid(tables, kits).select(
        F.col("kit_prod_number").alias("kit_product_number"), "kit_edi", "percent_invalid"
    )
    places = _shown_bins(tables, kits).withColumnRenamed("kit_prod_number", "kit_product_number")
    by = ["kit_edi", "kit_description", "kit_bin"]
    bins = in_pieces(places, ["kit_product_number"], F.col("kit_bin"), by, "bins")
    return (
        kit_components(tables, kits, details)
        .join(bins, "kit_product_number")
        .join(percent, ["kit_product_number", "kit_edi"], "left")
    )


@dataclass(frozen=True)
class _Report:
    """What the report and its counts are made of; a part that is used twice is stored.

    ``components`` is there only if the report rows themselves are asked for; then
    ``repetition`` also has the number of ``pieces`` that a component's rows are held in.
    """

    serials: DataFrame
    repetition: DataFrame
    contents: DataFrame
    components: DataFrame | None
    shared: Callable[[DataFrame], DataFrame]

    def sizes(self) -> DataFrame:
        """Per kit its serial rows, and the component rows of a serial, of all components and of
        the one with most."""
        key = "kit_product_number"
        serials = self.serials.groupBy(F.col("kit_number").alias(key)).agg(
            F.sum("serial_rows").alias("left_rows")
        )
        components = self.repetition.groupBy(key).agg(
            F.sum("times").alias("right_rows"),
            F.max("times").alias("most_rows"),
            F.max("pieces").alias("pieces"),
        )
        return self.shared(serials.join(components, key))


def _report(
    tables: Tables, kits=None, requests: DataFrame | None = None, with_rows: bool = True
) -> _Report:
    if requests is not None:
        kits = _kits_of(requests)
    components = None
    if with_rows:
        components = tables.shared(_report_components(tables, kits))
        standard = F.col("component_quantity_in_kit")
        bins = F.when(F.col("loose").isNull(), 1).otherwise(F.size("loose")) * F.size("bins")
        times = bins.cast("long")
        repetition = components.groupBy(
            "kit_product_number", "component_prod_id", "component_product_number"
        ).agg(
            F.sum(times).alias("times"),
            F.sum(F.when(standard.isNotNull(), times).otherwise(0)).alias("known"),
            F.sum(times * standard).alias("wanted"),
            F.count(F.lit(1)).alias("pieces"),
        )
    else:
        repetition = _repetition(tables, kits)
    contents = serial_contents(tables, kits).where(F.col("serial_number").isNotNull())
    # The counts alone read serials and contents once.
    twice = tables.shared if with_rows else lambda df: df
    return _Report(
        twice(_report_serials(tables, kits, requests)),
        tables.shared(repetition),
        twice(
            contents.select(
                F.col("kit_prod_number").alias("kit_product_number"),
                "serial_number",
                F.col("component_edi").alias("component_prod_id"),
                "quantity_available",
            )
        ),
        components,
        tables.shared,
    )


def _shortfall(report: _Report) -> DataFrame:
    """Missing pieces per kit serial, over the repeated rows of the report.

    Equal to adding up ``standard - quantity`` over the report rows of the serial,
    without building these rows: a component with no contents adds its standard
    once per repetition; one with m content rows adds m times its standard less
    what they hold. So the kit's total is the same for all its serials, and only
    what a serial does hold is accounted for separately.

    Columns: kit_number, serial_number, serial_rows, report_rows (rows per serial row),
    pieces_missing, components_missing (report rows whose quantity is zero).
    """
    whole_kit = report.repetition.groupBy(F.col("kit_product_number").alias("kit_number")).agg(
        F.sum("wanted").alias("wanted"), F.sum("times").alias("report_rows")
    )
    zero = F.lit(0).cast("long")
    matches = F.col("matches")
    wanted = F.coalesce("wanted", zero)
    held = (
        _held(report.contents)
        .join(report.repetition, ["kit_product_number", "component_prod_id"])
        .groupBy(F.col("kit_product_number").alias("kit_number"), "serial_number")
        .agg(
            F.sum((matches - 1) * wanted - F.col("quantity") * F.col("known")).alias("change"),
            F.sum((matches - F.col("filled") - 1) * F.col("times")).alias("row_change"),
        )
    )
    rows = F.col("serial_rows")
    return (
        report.serials.join(whole_kit, "kit_number")
        .join(held, ["kit_number", "serial_number"], "left")
        .select(
            "kit_number",
            "serial_number",
            "serial_rows",
            "report_rows",
            (rows * (F.col("wanted") + F.coalesce("change", zero))).alias("pieces_missing"),
            (rows * (F.col("report_rows") + F.coalesce("row_change", zero))).alias(
                "components_missing"
            ),
        )
    )


def pieces_missing(tables: Tables, kits=None) -> DataFrame:
    return _shortfall(_report(tables, kits, with_rows=False)).select(
        "kit_number", "serial_number", "pieces_missing"
    )


def _repeat(serials: DataFrame) -> DataFrame:
    """One row per report row of a serial (``serial_rows`` is 1 unless products share
    a kit number)."""
    return serials.withColumn(
        "serial_rows", F.explode(F.sequence(F.lit(1).cast("long"), "serial_rows"))
    ).drop("serial_rows")


def _placed(report: _Report, serials: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Serials (kit_product_number, serial_number, ...) and the components of their kits, with the
    box of a heavy kit that they meet in."""
    key = "kit_product_number"
    heavy = heavy_boxes(sizes, key)
    item = F.xxhash64("component_product_number", "component_prod_id")
    return (
        box_rows(serials, heavy, key, _lt=F.xxhash64("serial_number")),
        box_rows(report.components, heavy, key, _rt=item, _bt=F.xxhash64("loose_piece", "bins_piece")),
    )


def _met(serials: DataFrame, components: DataFrame, contents: DataFrame, *also: str) -> DataFrame:
    """Serials with each component of their kit, what they hold of it, and its bins as lists.

    The rows that are shuffled to meet the contents don't repeat for every bin.
    """
    key = ["kit_product_number", *also]
    return (
        serials.join(components, [*key, *BOX])
        .join(contents, [*key, "serial_number", "component_prod_id"], "left")
        .withColumn("qty_in_kit", F.coalesce("quantity_available", F.lit(0).cast("long")))
    )


def _expanded(rows: DataFrame) -> DataFrame:
    """A row for every bin with loose pieces and every kit bin of a row."""
    return (
        rows.withColumn("loose", F.explode_outer("loose"))
        .withColumn("kit_bin", F.explode("bins"))
        .withColumns({c: F.col(f"loose.{c}") for c in ("component_bin", "qty_avail_sh")})
    )


def _grid(report: _Report, serials: DataFrame) -> DataFrame:
    """Report rows of the serials; bins multiply them at the very end."""
    sizes = report.sizes()
    serials, components = _placed(report, serials, sizes)
    serials = spread(serials, total_rows(sizes), "kit_product_number", *BOX)
    return _expanded(_met(serials, components, report.contents))


#: The report's order: the largest share of invalid kits first with unknown shares leading,
#: then kit, serial and component number with NULLs last.
REPORT_ORDER = {
    "percent_invalid": F.desc_nulls_first,
    "kit_product_number": F.asc_nulls_last,
    "serial_number": F.asc_nulls_last,
    "component_product_number": F.asc_nulls_last,
}


def _report_order() -> list:
    return [direction(column) for column, direction in REPORT_ORDER.items()]


def kit_breakout(tables: Tables, kits=None, ordered: bool = False) -> DataFrame:
    """The breakout report of all kits, or of the given ones; ``ordered`` sorts it."""
    report = _report(tables, kits)
    serials = _repeat(_shortfall(report)).withColumnRenamed("kit_number", "kit_product_number")
    rows = _grid(report, serials).select(*REPORT_COLUMNS)
    return rows.orderBy(*_report_order()) if ordered else rows


def kit_breakout_in_order(tables: Tables, kits=None) -> DataFrame:
    """The breakout report with each row's ``position`` in the report's order."""
    return positioned(kit_breakout(tables, kits), *_report_order())


def report_parts(tables: Tables) -> dict[str, DataFrame]:
    """All kits' serials, components and contents, placed so that they join kit by kit."""
    report = _report(tables)
    serials = _repeat(_shortfall(report)).withColumnRenamed("kit_number", "kit_product_number")
    serials, components = _placed(report, serials, report.sizes())
    return {"serials": serials, "components": components, "contents": report.contents}


def join_parts(parts: dict[str, DataFrame], *also: str) -> DataFrame:
    """The report from its parts, joined by the columns ``also``, too."""
    rows = _met(parts["serials"], parts["components"], parts["contents"], *also)
    return _expanded(rows).select(*REPORT_COLUMNS, *also)


def _with_absent(rows: DataFrame, report: _Report, requests: DataFrame) -> DataFrame:
    """Add a row for each requested serial that is not in the report."""
    absent = requests.select("kit_number", "serial_number").join(
        report.serials, ["kit_number", "serial_number"], "left_anti"
    )
    return rows.unionByName(absent, allowMissingColumns=True)


def serial_breakout(tables: Tables, requests: DataFrame) -> DataFrame:
    """Report rows of the requested serials, in long form. A requested serial that
    is not in the report keeps one row without a component."""
    report = _report(tables, requests=requests)
    serials = _repeat(report.serials).withColumnRenamed("kit_number", "kit_product_number")
    rows = _grid(report, serials).select(
        F.col("kit_product_number").alias("kit_number"),
        "serial_number",
        "component_product_number",
        "component_prod_id",
        "component_description",
        "qty_in_kit",
        "qty_avail_sh",
        "qty_avail_e01",
    )
    return _with_absent(rows, report, requests)


def _kits_of(requests: DataFrame) -> DataFrame:
    return requests.select("kit_number").distinct()


def serial_diff(tables: Tables, requests: DataFrame) -> DataFrame:
    """Missing pieces and number of missing components of every requested serial; 0
    for a serial that is not in the report."""
    shortfall = _shortfall(_report(tables, requests=requests, with_rows=False))
    zero = F.lit(0).cast("long")
    return (
        requests.select("kit_number", "serial_number")
        .join(shortfall, ["kit_number", "serial_number"], "left")
        .select(
            "kit_number",
            "serial_number",
            F.coalesce("pieces_missing", zero).alias("pieces_missing"),
            F.coalesce("components_missing", zero).alias("components_missing"),
        )
    )


def serial_missing_components(tables: Tables, requests: DataFrame) -> DataFrame:
    """The report rows of the requested serials that hold none of their component."""
    report = _report(tables, requests=requests)
    serials = _repeat(report.serials).withColumnRenamed("kit_number", "kit_product_number")
    return (
        _grid(report, serials)
        .where(F.col("qty_in_kit") == 0)
        .select(
            F.col("kit_product_number").alias("kit_number"),
            "serial_number",
            "component_product_number",
            "component_prod_id",
            "component_description",
        )
    )


def requested_contents(tables: Tables, requests: DataFrame) -> DataFrame:
    """Pieces pooled from the requested serials the way the report counts them: each
    report row contributes its quantity, so repeated rows count repeatedly.

    Columns: kit_number, component, quantity.
    """
    kits = _kits_of(requests)
    serials = _report_serials(tables, kits, requests)
    contents = serial_contents(tables, kits).select(
        F.col("kit_prod_number").alias("kit_number"),
        "serial_number",
        F.col("component_edi").alias("component_prod_id"),
        F.coalesce("quantity_available", F.lit(0).cast("long")).alias("quantity"),
    )
    key = ["kit_number", "component_prod_id"]
    held = (
        contents.join(serials, ["kit_number", "serial_number"])
        .groupBy(*key)
        .agg(F.sum(F.col("quantity") * F.col("serial_rows")).alias("quantity"))
    )
    return (
        held.join(
            _repetition(tables, kits).withColumnRenamed("kit_product_number", "kit_number"), key
        )
        .groupBy("kit_number", F.col("component_product_number").alias("component"))
        .agg(F.sum(F.col("quantity") * F.col("times")).alias("quantity"))
    )
