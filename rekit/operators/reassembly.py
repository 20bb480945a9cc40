"""Rebuild kits from the pooled pieces of broken-out serials.

Requested serials are served in order; each takes the standard quantity of every
component the pool still covers, complete or not. Components do not compete with
each other and every slot takes the same quantity, so the outcome follows from one
number per kit and component: how many slots it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rekit.functions.expressions import fill_count
from rekit.functions.skew import spread
from rekit.operators.breakout import requested_contents
from rekit.operators.corrected import requested_contents_corrected
from rekit.operators.standard import build_standard
from rekit.sources.tables import Tables

VALID, INVALID, NO_STANDARD = "valid", "invalid", "no_standard"

# Slots per block in running counts, and per join key when listing builds.
COUNT_BITS = 16
LINE_BITS = 12
# Components per join key when listing builds, about.
LINE_COMPONENTS = 1_024


def component_pool(tables: Tables, requests: DataFrame, as_reported: bool = False) -> DataFrame:
    """What the requested serials of each kit hold together, per standard component.

    ``as_reported`` counts pieces as often as the breakout report repeats them.
    Columns: kit_number, component, std_qty, standard_rows, pool.
    """
    zero = F.lit(0).cast("long")
    standard = build_standard(tables, requests.select("kit_number").distinct())

    def per_component(rows, *more):
        return rows.groupBy("kit_number", "component").agg(
            F.when(F.count("std_qty") == F.count(F.lit(1)), F.sum("std_qty")).alias("std_qty"),
            F.sum("standard_rows").alias("standard_rows"),
            *more,
        )

    if as_reported:
        pooled = requested_contents(tables, requests)
        counted = per_component(standard).join(pooled, ["kit_number", "component"], "left")
        return counted.select(
            "kit_number",
            "component",
            "std_qty",
            "standard_rows",
            F.coalesce("quantity", zero).alias("pool"),
        )
    pooled = requested_contents_corrected(tables, requests)
    return per_component(
        standard.join(pooled, ["kit_number", "component_product_id"], "left"),
        F.coalesce(F.sum("quantity"), zero).alias("pool"),
    )


def slot_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("kit_number").agg(F.count(F.lit(1)).alias("slots"))


def component_fill(pool: DataFrame, requests: DataFrame) -> DataFrame:
    """Slots served (``fill``) and pieces left over, per kit and component."""
    return (
        pool.join(slot_counts(requests), "kit_number")
        .withColumn("fill", fill_count())
        .withColumn(
            "leftover",
            F.col("pool") - F.coalesce("std_qty", F.lit(0).cast("long")) * F.col("fill"),
        )
    )


def _required(fill: DataFrame, as_reported: bool) -> DataFrame:
    """Entries a complete build has. The report counts standard rows, so there a kit
    whose standard repeats a component is never complete."""
    entries = F.sum("standard_rows") if as_reported else F.count(F.lit(1))
    return fill.groupBy("kit_number").agg(entries.alias("required"))


def assembly_serial_status(
    fill: DataFrame, requests: DataFrame, as_reported: bool = False
) -> DataFrame:
    """Components built into each requested serial, and whether that is all of them.

    Slot r receives the components with fill >= r. These are counted from the back
    over blocks of slots: inside a block by a window, and from later blocks by a
    running sum over block totals.
    """
    block = F.shiftright(F.col("pos") - 1, COUNT_BITS).alias("block")
    zero = F.lit(0).cast("long")
    slots = requests.select("kit_number", F.col("build_pos").alias("pos"), "serial_number")
    last_served = (
        fill.where(F.col("fill") > 0)
        .groupBy("kit_number", F.col("fill").alias("pos"))
        .agg(F.count(F.lit(1)).alias("entries"))
    )
    marks = slots.select("*", F.lit(True).alias("is_slot"), zero.alias("entries")).unionByName(
        last_served.withColumn("is_slot", F.lit(False)), allowMissingColumns=True
    )
    marks = marks.select("*", block)

    later = (
        Window.partitionBy("kit_number")
        .orderBy(F.col("block").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    carried = (
        marks.groupBy("kit_number", "block")
        .agg(F.sum("entries").alias("entries"))
        .withColumn("carried", F.coalesce(F.sum("entries").over(later), zero))
        .drop("entries")
        .join(_required(fill, as_reported), "kit_number", "left")
    )
    from_here = (
        Window.partitionBy("kit_number", "block")
        .orderBy(F.col("pos").desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = (
        marks.withColumn("here", F.sum("entries").over(from_here))
        .where(F.col("is_slot"))
        .join(carried, ["kit_number", "block"])
        .withColumn("components_in_kit", F.col("here") + F.col("carried"))
    )
    return counted.select(
        "kit_number",
        "serial_number",
        F.col("pos").alias("build_pos"),
        "components_in_kit",
        F.when(F.col("required").isNull(), NO_STANDARD)
        .when(F.col("components_in_kit") == F.col("required"), VALID)
        .otherwise(INVALID)
        .alias("status"),
    )


def assembly_build_lines(
    fill: DataFrame, slots: DataFrame, lines: int | None = None
) -> DataFrame:
    """What goes into each rebuilt serial: one row per component received.

    ``slots`` are requests or serial statuses; their further columns are kept. A
    component is sent once to every block of slots it reaches, not once per slot. The
    components of a kit are dealt into parts, and a slot is sent once to every part, so a
    task holds about 2**LINE_BITS * LINE_COMPONENTS rows of a kit at most.
    ``lines``, if known, is the number of rows to expect.
    """
    served = fill.where(F.col("fill") > 0)
    parts = served.groupBy("kit_number").agg(
        F.ceil(F.count(F.lit(1)) / LINE_COMPONENTS).cast("long").alias("_parts")
    )
    reach = served.join(parts, "kit_number").select(
        "kit_number",
        F.pmod(F.xxhash64("component"), F.col("_parts")).alias("_part"),
        "component",
        F.col("std_qty").alias("qty"),
        "fill",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("fill") - 1, LINE_BITS))
        ).alias("block"),
    )
    placed = (
        slots.withColumn("block", F.shiftright(F.col("build_pos") - 1, LINE_BITS))
        .join(parts, "kit_number")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        .drop("_parts")
    )
    placed = spread(placed, lines or 0, "kit_number", "block", "_part")
    return (
        placed.join(reach, ["kit_number", "block", "_part"])
        .where(F.col("build_pos") <= F.col("fill"))
        .drop("block", "_part", "fill")
    )


def reassembly_summary(
    fill: DataFrame, requests: DataFrame, as_reported: bool = False
) -> DataFrame:
    """Per kit: slots, valid and invalid rebuilds, pieces pooled and left over.

    A slot is complete exactly if every component reaches it, so the number of valid
    kits is the smallest fill. A kit without a standard has neither.
    """
    zero = F.lit(0).cast("long")
    complete = F.min("fill")
    if as_reported:
        complete = F.when(F.max("standard_rows") == 1, complete).otherwise(zero)
    kits = fill.groupBy("kit_number").agg(
        complete.alias("valid_kits"),
        F.sum("pool").alias("total_pieces"),
        F.sum("leftover").alias("leftover_pieces"),
    )
    return (
        slot_counts(requests)
        .join(kits, "kit_number", "left")
        .select(
            "kit_number",
            "slots",
            F.coalesce("valid_kits", zero).alias("valid_kits"),
            F.coalesce(F.col("slots") - F.col("valid_kits"), zero).alias("invalid_kits"),
            F.coalesce("total_pieces", zero).alias("total_pieces"),
            F.coalesce("leftover_pieces", zero).alias("leftover_pieces"),
        )
    )


def assembly_serial_report(status: DataFrame) -> DataFrame:
    return status.select("kit_number", "serial_number", "status", "components_in_kit")


def line_count(fill: DataFrame) -> int:
    return fill.agg(F.sum("fill")).first()[0] or 0


def assembly_serial_sheets(
    fill: DataFrame, status: DataFrame, lines: int | None = None
) -> DataFrame:
    """Build lines under their serial's status, in upper case as a heading. A serial
    that received nothing has no line here; the serial report lists it."""
    return assembly_build_lines(fill, status, lines).select(
        "kit_number",
        "serial_number",
        F.upper("status").alias("status"),
        "component",
        F.col("qty").alias("qty_in_kit"),
    )
