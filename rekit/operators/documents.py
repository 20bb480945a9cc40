"""Nested forms of the results, for JSON output.

Every frame has one row per entry, with what holds for the whole kit or serial beside it.
The shape is the same at every size, and no kit has to fit into one row or task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekit.functions.skew import positioned
from rekit.operators.breakout import _grid, _repeat, _report, _shortfall, _with_absent
from rekit.operators.reassembly import assembly_build_lines, line_count
from rekit.operators.standard import kit_standard_map
from rekit.sources.tables import Tables


def standard_documents(tables: Tables, kits=None) -> DataFrame:
    """kit_number, total_pieces, component, standard: edi, description and quantity."""
    return kit_standard_map(tables, kits).select(
        "kit_number",
        "total_pieces",
        "component",
        F.struct("edi", "description", "component_qty_standard").alias("standard"),
    )


def breakout_documents(tables: Tables, requests: DataFrame) -> DataFrame:
    """kit_number, serial_number, pieces_missing, breakout, missing: a report row of a
    requested serial, and whether the serial holds none of its component.

    A requested serial that is not in the report keeps one row without a report row.
    """
    report = _report(tables, requests=requests)
    serials = _repeat(_shortfall(report)).withColumnRenamed("kit_number", "kit_product_number")
    line = F.struct(
        "component_product_number",
        "component_prod_id",
        "component_description",
        "qty_in_kit",
        "qty_avail_sh",
        "qty_avail_e01",
    )
    rows = _grid(report, serials).select(
        F.col("kit_product_number").alias("kit_number"),
        "serial_number",
        "pieces_missing",
        line.alias("breakout"),
        (F.col("qty_in_kit") == 0).alias("missing"),
    )
    return _with_absent(rows, report, requests).select(
        "kit_number",
        "serial_number",
        F.coalesce("pieces_missing", F.lit(0).cast("long")).alias("pieces_missing"),
        "breakout",
        F.coalesce("missing", F.lit(False)).alias("missing"),
    )


#: Entries of a page, unless the caller says otherwise.
PAGE = 1_000


def standard_pages(tables: Tables, kits=None, size: int = PAGE) -> DataFrame:
    """kit_number, total_pieces, page, entries: a kit's standard as lists of ``size`` entries by
    component in byte order; only a kit's last page may have fewer.

    The list of a whole kit would have no bound; a page has one, and pages from 0 on are the list.
    """
    entry = F.struct(
        "component", "standard.edi", "standard.description", "standard.component_qty_standard"
    )
    rows = standard_documents(tables, kits).select("kit_number", "total_pieces", entry.alias("entry"))
    return _paged(rows, ["kit_number", "total_pieces"], "entry", size)


def _paged(rows: DataFrame, group: list[str], entry: str, size: int) -> DataFrame:
    """Entries of a group in lists of ``size``, in order. Places in the order of all groups come
    first, so no group is ever sorted by one task."""
    placed = positioned(rows, *group, F.col(entry))
    firsts = placed.groupBy(*group).agg(F.min("position").alias("_first"))
    page = F.floor((F.col("position") - F.col("_first")) / size)
    listed = F.sort_array(F.collect_list(F.struct("position", entry)))
    return (
        placed.join(firsts, group)
        .groupBy(*group, page.alias("page"))
        .agg(F.transform(listed, lambda e: e[entry]).alias("entries"))
    )


def component_count_documents(fill: DataFrame) -> DataFrame:
    """kit_number, total_pieces, component, leftover: what is left of each component after
    the rebuild, beside the number of pieces there were before it."""
    totals = fill.groupBy("kit_number").agg(F.sum("pool").alias("total_pieces"))
    return fill.join(totals, "kit_number").select(
        "kit_number", "total_pieces", "component", "leftover"
    )


def assembly_documents(fill: DataFrame, status: DataFrame) -> DataFrame:
    """kit_number, build_pos, serial, status, build: a component that a rebuilt serial
    received and how many of it; a serial that received nothing keeps a row without."""
    columns = ["kit_number", "build_pos", "serial_number", "status"]
    lines = assembly_build_lines(fill, status.select(*columns), line_count(fill)).select(
        *columns, F.struct("component", "qty").alias("build")
    )
    bare = status.where(F.col("components_in_kit") == 0).select(*columns)
    return lines.unionByName(bare, allowMissingColumns=True).withColumnRenamed(
        "serial_number", "serial"
    )
