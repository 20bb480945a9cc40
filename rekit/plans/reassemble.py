"""Whole runs: from tables and requests to the results."""

from __future__ import annotations

import argparse
import datetime
import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rekit.operators import documents, reassembly
from rekit.operators.breakout import kit_breakout
from rekit.operators.standard import kit_standard
from rekit.session import exists, names, own_scratch, replace_text, store, tune
from rekit.sources import sinks
from rekit.sources.requests import (
    invalid_serial_requests,
    read_requests,
    requests_for,
    split_requests,
)
from rekit.sources.tables import Tables, read_parquet


@dataclass(frozen=True)
class Reassembly:
    """The results of a rebuild, as frames over the stored requests and fills.

    What several results need is worked out when the first of them is asked for, once.
    """

    requests: DataFrame
    fill: DataFrame
    as_reported: bool = False

    @cached_property
    def status(self) -> DataFrame:
        return store(
            reassembly.assembly_serial_status(self.fill, self.requests, self.as_reported)
        )

    @cached_property
    def line_count(self) -> int:
        return reassembly.line_count(self.fill)

    @property
    def lines(self) -> DataFrame:
        return reassembly.assembly_build_lines(self.fill, self.requests, self.line_count)

    @property
    def sheets(self) -> DataFrame:
        return reassembly.assembly_serial_sheets(self.fill, self.status, self.line_count)

    @property
    def summary(self) -> DataFrame:
        return reassembly.reassembly_summary(self.fill, self.requests, self.as_reported)

    @property
    def documents(self) -> DataFrame:
        return documents.assembly_documents(self.fill, self.status)


def reassemble(tables: Tables, requests: DataFrame, as_reported: bool = False) -> Reassembly:
    """Rebuild kits from requests (kit_number, serial_number, build_pos)."""
    requests = tables.shared(requests)
    pool = reassembly.component_pool(tables, requests, as_reported)
    fill = tables.shared(reassembly.component_fill(pool, requests))
    return Reassembly(requests, fill, as_reported)


def reassemble_kit(tables: Tables, kit_number: str, serials, as_reported=False) -> Reassembly:
    """Rebuild one kit from the serials given, in the order given."""
    accepted, _ = split_requests(requests_for(tables.spark, kit_number, serials))
    return reassemble(tables, accepted, as_reported)


def save(
    tables: Tables, raw_requests: DataFrame | None, out: str, as_reported=False, resume=False
) -> dict[str, int]:
    """Run a rebuild and write all of its outputs below ``out``; returns its totals.

    Requests and fills are stored first, so the outputs derived from them don't compute the
    pool again. The totals are observed while the summary is written. With ``resume``, outputs
    that are there and whole are kept as they are.
    """
    spark = tables.spark

    def write(writer, frame, name: str) -> None:
        if not (resume and exists(spark, f"{out}/{name}/_SUCCESS")):
            writer(frame(), f"{out}/{name}")

    if raw_requests is None:
        write(sinks.write_parquet, lambda: invalid_serial_requests(tables), "requests")
    else:
        accepted, rejected = split_requests(raw_requests)
        write(sinks.write_json, lambda: rejected, "rejected_requests")
        write(sinks.write_parquet, lambda: accepted, "requests")
    requests = spark.read.parquet(f"{out}/requests")

    def fill():
        pool = reassembly.component_pool(tables, requests, as_reported)
        return reassembly.component_fill(pool, requests)

    write(sinks.write_parquet, fill, "component_fill")
    result = Reassembly(requests, spark.read.parquet(f"{out}/component_fill"), as_reported)
    write(sinks.write_parquet, lambda: result.status, "assembly_status")
    seen = Observation()
    write(sinks.write_parquet, lambda: result.summary.observe(seen, *_totals()), "summary")
    write(sinks.write_csv, lambda: reassembly.assembly_serial_report(result.status), "serial_report")
    write(sinks.write_csv, lambda: result.sheets, "serial_sheets")
    kits = requests.select("kit_number").distinct() if raw_requests is not None else None
    write(sinks.write_json, lambda: documents.standard_documents(tables, kits), "std")
    write(sinks.write_json, lambda: documents.breakout_documents(tables, requests), "breakout")
    write(sinks.write_json, lambda: documents.component_count_documents(result.fill), "total_components")
    write(sinks.write_json, lambda: result.documents, "new_kit_assembly")
    if seen._jo is None:  # the summary was there already
        return spark.read.parquet(f"{out}/summary").agg(*_totals()).first().asDict()
    return seen.get


def _totals() -> list:
    zero = F.lit(0).cast("long")
    return [
        F.count(F.lit(1)).alias("kits"),
        F.coalesce(F.sum("slots"), zero).alias("serials"),
        F.coalesce(F.sum("valid_kits"), zero).alias("valid_kits"),
    ]


def save_run(
    tables: Tables, raw_requests: DataFrame | None, out: str, run: str, as_reported=False
) -> dict[str, int]:
    """As ``save``, into ``out/runs/<run>``; ``out/current.json`` names the run once all is there.

    Readers that go by that file (``latest``) never see half a run. A run that broke off goes
    on under the same name with what is missing; until it ends the one before stays current.
    """
    spark, folder = tables.spark, f"{out}/runs/{run}"
    totals = save(tables, raw_requests, folder, as_reported, resume=True)
    manifest = {"run": run, "folder": folder, "outputs": sorted(names(spark, folder)), "totals": totals}
    replace_text(spark, f"{out}/current.json", json.dumps(manifest))
    return totals


def latest(spark: SparkSession, out: str) -> dict | None:
    """The manifest of the last whole run below ``out``: run, folder, outputs and totals."""
    if not exists(spark, f"{out}/current.json"):
        return None
    return json.loads(spark.read.text(f"{out}/current.json", wholetext=True).first()[0])


def save_reports(tables: Tables, out: str, kits=None) -> None:
    """Write the kit standard and the breakout report as JSON lines."""
    sinks.write_json(kit_standard(tables, kits), f"{out}/kit_std")
    sinks.write_json(
        kit_breakout(tables, kits), f"{out}/kit_report", kit_column="kit_product_number"
    )


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--tables", required=True, help="folder with the six Parquet tables")
    wanted = parser.add_mutually_exclusive_group()
    wanted.add_argument("--requests", help="CSV with kit_number, serial_number, build_pos; "
                        "without it all invalid serials on site")
    wanted.add_argument("--kit", help="one kit, rebuilt from --serials in the order given")
    parser.add_argument("--serials", nargs="+", default=[], help="serial numbers of --kit")
    parser.add_argument("--out", required=True)
    parser.add_argument("--run", help="name of the run: a folder of its own below --out, current "
                        "once it is whole; a run that broke off goes on under its name")
    parser.add_argument("--reports", action="store_true", help="also write both reports")
    parser.add_argument("--as-of", type=datetime.date.fromisoformat, help="snapshot day")
    parser.add_argument("--as-reported", action="store_true")
    arguments = parser.parse_args(argv)
    if bool(arguments.kit) != bool(arguments.serials):
        parser.error("--kit and --serials belong together")
    spark = tune(SparkSession.builder.appName("rekit").getOrCreate())
    with own_scratch(spark):
        _run(spark, arguments)


def _run(spark: SparkSession, arguments: argparse.Namespace) -> None:
    tables = read_parquet(spark, arguments.tables, as_of=arguments.as_of)
    requests, kits = None, None
    if arguments.kit:
        requests, kits = requests_for(spark, arguments.kit, arguments.serials), [arguments.kit]
    elif arguments.requests:
        requests = read_requests(spark, arguments.requests)
        kits = requests.select("kit_number").distinct()
    out = arguments.out
    if arguments.run:
        totals, out = save_run(tables, requests, out, arguments.run, arguments.as_reported), f"{out}/runs/{arguments.run}"
    else:
        totals = save(tables, requests, out, arguments.as_reported)
    if arguments.reports:
        save_reports(tables, out, kits)
    print(f"{totals['kits']} kits, {totals['serials']} serials requested, "
          f"{totals['valid_kits']} valid kits: {out}/summary")
    if arguments.kit:
        spark.read.parquet(f"{out}/summary").show(truncate=False)


if __name__ == "__main__":
    main()
