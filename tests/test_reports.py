"""Orders, nested forms, files, SQL functions and plans."""

import json
import os
import re

import pytest

from rekit import session
from rekit.functions import expressions
from rekit.operators import breakout, corrected, documents, inventory, reassembly, standard
from rekit.plans import reassemble, sql_functions
from rekit.sources import sinks
from rekit.sources import tables as sources
from rekit.sources.requests import invalid_serial_requests
from tests.conftest import DAY
from tests.test_reassembly import REQUESTS, kit_tables, rebuild
from tests.test_report_random import warehouse


@pytest.fixture(scope="module")
def site(make_tables):
    """One kit, three serials, two components."""
    return kit_tables(
        make_tables,
        bom=[(1, 2), (2, 2)],
        units=[(1, 4), (2, 4), (3, 3)],
        contents=[(1, 2, 3), (2, 1, 1), (2, 1, 1)],
        loose=[(1, 3, 5), (1, 4, 9)],
    )


@pytest.fixture(scope="module")
def wanted(spark):
    """Serials 2 and 1, and one that is not on site."""
    return spark.createDataFrame([("K", 2, 1), ("K", 1, 2), ("K", 50, 3)], REQUESTS)


# Hand-made cases --------------------------------------------------------------------


def test_bin_label_is_null_with_a_null_part(spark):
    df = spark.createDataFrame(
        [("G", "1", "A"), ("G", None, "A")], "zone string, position string, shelf string"
    )
    assert [r[0] for r in df.select(expressions.bin_label()).collect()] == ["G-1-A", None]


@pytest.mark.parametrize(
    "valid, invalid, share", [(2, None, 0.0), (None, 3, 1.0), (1, 3, 0.75), (0, 0, None)]
)
def test_invalid_share(spark, valid, invalid, share):
    df = spark.createDataFrame([(valid, invalid)], "v bigint, i bigint")
    assert df.select(expressions.invalid_share("v", "i")).first()[0] == share


def test_signed_and_unsigned_shortage(site, wanted, rows):
    """Serial 1 has 3 of one component (1 too many) and none of the other."""
    assert rows(corrected.serial_diff_corrected(site, wanted)) == [
        ("K", 1, 1, 1, 2),
        ("K", 2, 2, 1, 2),
        ("K", 50, 4, 2, 4),
    ]


def test_diff_counts_repeated_rows(site, wanted, rows):
    """Two kit bins; component 1 lies in two loose bins: 4 and 2 rows per serial."""
    assert rows(breakout.serial_diff(site, wanted)) == [
        ("K", 1, 4 * 2 - 2 * 1, 4),
        ("K", 2, 2 * 2, 2),
        ("K", 50, 0, 0),
    ]


def test_corrected_report(site, rows):
    columns = (
        "serial_number",
        "kit_bin",
        "component_product_number",
        "qty_in_kit",
        "qty_avail_sh",
        "component_bin",
        "component_bins",
        "pieces_missing",
        "shortage",
    )
    assert rows(corrected.kit_breakout_corrected(site), *columns) == [
        (1, "G1-02-A", "C-1", 0, 14, "R2-01-A", 2, 1, 2),
        (1, "G1-02-A", "C-2", 3, None, None, None, 1, 0),
        (2, "G1-01-A", "C-1", 2, 14, "R2-01-A", 2, 2, 0),
        (2, "G1-01-A", "C-2", 0, None, None, None, 2, 2),
        (3, "G1-02-A", "C-1", 0, 14, "R2-01-A", 2, 4, 2),
        (3, "G1-02-A", "C-2", 0, None, None, None, 4, 2),
    ]


def test_one_kit_or_several(make_tables, spark, rows):
    tables = make_tables(**warehouse(0))
    everything = rows(breakout.kit_breakout(tables))
    one = [r for r in everything if r[0] == "K-2"]
    assert one and rows(breakout.kit_breakout(tables, kits=["K-2"])) == one
    frame = spark.createDataFrame([("K-2",)], "kit_number string")
    assert rows(breakout.kit_breakout(tables, kits=frame)) == one
    kits = [r for r in rows(standard.kit_standard(tables)) if r[0] in ("K-1", "K-3")]
    assert rows(standard.kit_standard(tables, kits=["K-1", "K-3"])) == kits


def test_report_order(make_tables):
    """Unknown shares lead, then falling shares; within a kit NULLs come last."""
    tables = make_tables(
        product=[dict(id=i, product_number=n, edi_number=n) for i, n in enumerate("ABC")]
        + [dict(id=10, product_number="p"), dict(id=11, product_number="o"), dict(id=12)],
        product_component=[
            dict(product_id=k, component_product_id=c) for k in range(3) for c in (10, 11, 12)
        ],
        product_serial=[dict(id=1, serial_number=8), dict(id=2, serial_number=3)],
        bin=[dict(id=1)],
        stock=[
            dict(id=1, product_id=0, serial_id=1, stock_type=3, container_id=1),
            dict(id=2, product_id=0, serial_id=2, stock_type=4, container_id=1),
            dict(id=3, product_id=0, serial_id=None, stock_type=4, container_id=1),
            dict(id=4, product_id=1, serial_id=1, stock_type=4, container_id=1),
            # both sums are zero
            dict(id=5, product_id=2, serial_id=1, stock_type=4, container_id=1, quantity_on_hand=0),
            dict(id=6, product_id=2, serial_id=1, stock_type=3, container_id=1, quantity_on_hand=0),
        ],
    )
    report = breakout.kit_breakout(tables, ordered=True).collect()
    assert [
        (r.kit_product_number, r.serial_number, r.component_product_number) for r in report
    ] == [
        (kit, serial, part)
        for kit, serials in (("C", [8]), ("B", [8]), ("A", [3, 8, None]))
        for serial in serials
        for part in ("o", "p", None)
    ]
    assert [r.product_number for r in standard.kit_standard(tables, ordered=True).collect()] == [
        "o", "p", None
    ] * 3


# Nested forms -----------------------------------------------------------------------


def test_documents_hold_what_the_flat_forms_do(site, wanted, rows):
    found = documents.standard_documents(site).collect()
    assert {(d.kit_number, d.total_pieces) for d in found} == {("K", 2)}
    assert {d.component: d.standard.component_qty_standard for d in found} == {"C-1": 2, "C-2": 2}

    found = documents.breakout_documents(site, wanted).collect()
    lines = [(d.kit_number, d.serial_number, *d.breakout) for d in found if d.breakout]
    missing = {d.serial_number: [d.pieces_missing, 0] for d in found}
    for d in found:
        missing[d.serial_number][1] += d.missing
    flat = breakout.serial_breakout(site, wanted).where("component_product_number is not null")
    assert sorted(lines, key=repr) == sorted(map(tuple, flat.collect()), key=repr)
    assert sorted((s, *v) for s, v in missing.items()) == rows(
        breakout.serial_diff(site, wanted), "serial_number", "pieces_missing", "components_missing"
    )

    run = reassemble.reassemble(site, wanted)
    found = documents.component_count_documents(run.fill).collect()
    assert {d.component: d.leftover for d in found} == {
        r.component: r.leftover for r in run.fill.collect()
    }
    assert {d.total_pieces for d in found} == {5}

    found = run.documents.collect()
    built = [(d.serial, d.build.component, d.build.qty) for d in found if d.build]
    assert sorted(built) == rows(run.lines, "serial_number", "component", "qty")
    assert sorted({(d.serial, d.status) for d in found}) == rows(
        run.status, "serial_number", "status"
    )


def test_assembly_documents_keep_serials_without_pieces(spark):
    run = rebuild(spark, [("K", "A", 1, 1)], {"K": [9, 3, 7]})
    found = sorted((d.build_pos, d.serial, d.build is not None) for d in run.documents.collect())
    assert found == [(1, 9, True), (2, 3, False), (3, 7, False)]


def test_an_unknown_quantity_makes_a_sum_unknown(make_tables, rows):
    tables = kit_tables(make_tables, bom=[(1, 2), (1, None), (2, 3)], units=[(1, 4)], contents=[])
    for operator, quantity in ((standard.kit_standard_map, "component_qty_standard"), (standard.build_standard, "std_qty")):
        assert rows(operator(tables), "component", quantity) == [("C-1", None), ("C-2", 3)]


# Files and whole runs ---------------------------------------------------------------


def test_whole_run(spark, make_tables, tmp_path, rows):
    tables = make_tables(**warehouse(100))
    sources.write_parquet(tables, f"{tmp_path}/in")
    loaded = sources.read_parquet(spark, f"{tmp_path}/in", as_of=DAY)
    out = f"{tmp_path}/out"
    reassemble.save(loaded, None, out)
    requests = invalid_serial_requests(loaded)
    run = reassemble.reassemble(loaded, requests)
    assert rows(spark.read.parquet(f"{out}/requests")) == rows(requests.select("*"))
    assert rows(spark.read.parquet(f"{out}/summary")) == rows(run.summary)
    assert rows(spark.read.parquet(f"{out}/assembly_status")) == rows(run.status)
    report = spark.read.csv(f"{out}/serial_report", header=True)
    assert report.columns == ["kit_number", "serial_number", "status", "components_in_kit"]
    assert report.count() == requests.count() > 0
    assert spark.read.csv(f"{out}/serial_sheets", header=True).count() == run.lines.count()
    for name in ("std", "breakout", "total_components", "new_kit_assembly"):
        assert spark.read.text(f"{out}/{name}").count() > 0


def test_reports_as_files_per_kit(site, tmp_path):
    sinks.write_json(standard.kit_standard(site), str(tmp_path / "std"), per_kit=True)
    (folder,) = tmp_path.glob("std/kit_number=*")
    assert folder.name == "kit_number=K"
    lines = [json.loads(x) for f in folder.glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(line["product_number"] for line in lines) == ["C-1", "C-2"]
    # unknown values stay in the file as null
    assert {line["description"] for line in lines} == {None}
    reassemble.save_reports(site, str(tmp_path / "all"))
    assert (tmp_path / "all" / "kit_report" / "_SUCCESS").exists()


def test_sql_functions(spark, site):
    sql_functions.register(site)
    found = spark.sql("SELECT * FROM kit_std_breakout(:kit)", args={"kit": "K"})
    assert found.columns == standard.kit_standard(site).columns
    assert [r.product_number for r in found.collect()] == ["C-1", "C-2"]
    assert spark.sql("SELECT * FROM kit_std_breakout(\"' OR ''='\")").count() == 0
    report = spark.sql("SELECT * FROM kit_breakout('K')")
    assert report.columns == breakout.REPORT_COLUMNS
    assert sorted(map(tuple, report.collect()), key=repr) == sorted(
        map(tuple, breakout.kit_breakout(site).collect()), key=repr
    )


def test_a_call_reads_only_the_files_of_its_kit(spark, make_tables, tmp_path):
    tables = make_tables(**warehouse(1))
    sql_functions.write_store(tables, str(tmp_path), buckets=64)
    sql_functions.register_store(spark, str(tmp_path))
    kits = [r[0] for r in standard.kit_standard(tables).select("kit_number").distinct().collect()]
    assert len(kits) > 2
    for function, operator, column in (
        ("kit_std_breakout", standard.kit_standard, "kit_number"),
        ("kit_breakout", breakout.kit_breakout, "kit_product_number"),
    ):
        every = operator(tables).collect()
        for kit in [*kits, "unknown"]:
            called = spark.sql(f"SELECT * FROM {function}(:kit)", args={"kit": kit})
            expected = [tuple(r) for r in every if r[column] == kit]
            assert sorted(map(tuple, called.collect()), key=repr) == sorted(expected, key=repr)
            # The share is known when the query is planned, in every part that it reads.
            share = spark.sql("SELECT pmod(xxhash64(:kit), 64)", args={"kit": kit}).first()[0]
            scans = re.findall(r"FileScan parquet .*", plan(called))
            assert scans
            for scan in scans:
                filters = re.search(r"PartitionFilters: \[(.*?)\], Pushed", scan)[1]
                assert f"= {share})" in filters and "EqualTo" in scan and kit in scan
        assert spark.sql(f"SELECT * FROM {function}(NULL)").count() == 0


# Plans ------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_multiplies_rows_blindly_or_leaves_the_jvm(spark, site, wanted):
    run = reassemble.reassemble(site, wanted)
    frames = [
        breakout.kit_breakout(site, ordered=True),
        breakout.serial_kit_grid(site),
        breakout.serial_breakout(site, wanted),
        breakout.serial_diff(site, wanted),
        corrected.kit_breakout_corrected(site),
        corrected.serial_diff_corrected(site, wanted),
        standard.kit_standard(site),
        inventory.serial_contents(site),
        invalid_serial_requests(site),
        run.fill,
        run.summary,
        run.status,
        run.lines,
        reassembly.assembly_serial_sheets(run.fill, run.status),
    ]
    for frame in frames:
        text = plan(frame)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
            assert bad not in text, (bad, text[:2000])


def test_scans_read_few_columns_and_filter_early(spark, make_tables, tmp_path):
    sources.write_parquet(make_tables(**warehouse(1)), str(tmp_path))
    tables = sources.read_parquet(spark, str(tmp_path), as_of=DAY)
    units = plan(inventory.kit_units(tables.with_settings(storing=False)))
    assert "In(stock_type, [3,4])" in units
    kits = plan(inventory.unique_kits(tables))
    assert "ReadSchema: struct<kit_id:bigint,inventory_type:int>" in kits
    assert "EqualTo(inventory_type,3)" in kits
    loose = plan(inventory.loose_availability(tables))
    assert "StringStartsWith(zone,R)" in loose
    assert re.search(r"Filter .*quantity_available#\d+L > 0.*\n.*FileScan", loose)


def test_one_kit_reaches_the_scan(spark, make_tables, tmp_path):
    """Asking for one kit filters the scan of kit units, not only the finished report."""
    sources.write_parquet(make_tables(**warehouse(1)), str(tmp_path))
    tables = sources.read_parquet(spark, str(tmp_path), as_of=DAY)
    everything = tables.stock.count()
    units = inventory.kit_units(tables, kits=["K-1"])
    assert 0 < units.count() < everything
    assert {r.kit_number for r in units.collect()} == {"K-1"}
    text = plan(inventory.kit_units(tables.with_settings(storing=False), kits=["K-1"]))
    # The kit's products meet the scan of the stock table, before bins and serials.
    assert "EqualTo(product_number,K-1)" in text and "LeftSemi" in text
    for operator in (standard.kit_standard, breakout.kit_breakout, breakout.serial_kit_grid):
        whole = [tuple(r) for r in operator(tables).collect() if r[0] == "K-1"]
        one = [tuple(r) for r in operator(tables, kits=["K-1"]).collect()]
        assert sorted(one, key=repr) == sorted(whole, key=repr)
        assert whole or operator is not standard.kit_standard


def test_command_line(spark, make_tables, tmp_path, capsys):
    sources.write_parquet(make_tables(**warehouse(100)), f"{tmp_path}/in")
    serial = invalid_serial_requests(sources.read_parquet(spark, f"{tmp_path}/in", as_of=DAY)).first()
    arguments = ["--tables", f"{tmp_path}/in", "--as-of", str(DAY)]
    one = ["--kit", serial.kit_number, "--serials", str(serial.serial_number)]
    reassemble.main([*arguments, "--out", f"{tmp_path}/one", *one, "--reports"])
    assert "1 kits, 1 serials requested" in capsys.readouterr().out
    for name in ("kit_std", "kit_report", "summary", "new_kit_assembly"):
        assert spark.read.text(f"{tmp_path}/one/{name}").count() > 0
    reassemble.main([*arguments, "--out", f"{tmp_path}/all"])
    assert spark.read.parquet(f"{tmp_path}/all/summary").count() > 1


def test_a_run_that_is_cut_short_leaves_the_last_one_whole(spark, make_tables, tmp_path, monkeypatch, rows):
    tables, out = make_tables(**warehouse(100)), str(tmp_path)
    assert reassemble.latest(spark, out) is None
    totals = reassemble.save_run(tables, None, out, "one")
    first = reassemble.latest(spark, out)
    assert first["run"] == "one" and first["outputs"] == sorted(f.name for f in (tmp_path / "runs" / "one").iterdir())
    summary = spark.read.parquet(f"{first['folder']}/summary")
    sums = summary.selectExpr("count(*)", "sum(slots)", "sum(valid_kits)").first()
    assert totals == first["totals"] == dict(zip(("kits", "serials", "valid_kits"), sums))

    # The second run breaks off while it writes its sheets.
    written, original = [], sinks.write_csv

    def broken(df, path, **more):
        written.append(path)
        if path.endswith("serial_sheets"):
            raise OSError("lost")
        original(df, path, **more)

    monkeypatch.setattr(sinks, "write_csv", broken)
    with pytest.raises(OSError):
        reassemble.save_run(tables, None, out, "two")
    assert reassemble.latest(spark, out) == first
    monkeypatch.setattr(sinks, "write_csv", lambda df, path, **more: written.append(path) or original(df, path, **more))
    before = (tmp_path / "runs" / "two" / "component_fill" / "_SUCCESS").stat().st_mtime_ns
    assert reassemble.save_run(tables, None, out, "two") == totals
    # What was whole stays, the rest is written.
    assert (tmp_path / "runs" / "two" / "component_fill" / "_SUCCESS").stat().st_mtime_ns == before
    assert [w.rpartition("/")[2] for w in written] == ["serial_report", "serial_sheets", "serial_sheets"]
    second = reassemble.latest(spark, out)
    assert second["run"] == "two" and second["outputs"] == first["outputs"]
    for name in ("summary", "assembly_status", "component_fill"):
        assert rows(spark.read.parquet(f"{second['folder']}/{name}")) == rows(spark.read.parquet(f"{first['folder']}/{name}"))


def test_pages_have_their_size(make_tables, rows):
    tables = make_tables(**warehouse(2))
    entries = {}
    for r in documents.standard_documents(tables).collect():
        entries.setdefault((r.kit_number, r.total_pieces), []).append((r.component, *r.standard))
    for size in (1, 2, 3, 1_000):
        pages = documents.standard_pages(tables, size=size).collect()
        found = {}
        for r in sorted(pages, key=lambda r: r.page):
            found.setdefault((r.kit_number, r.total_pieces), []).append([tuple(e) for e in r.entries])
        assert {k: [e for page in v for e in page] for k, v in found.items()} == {
            k: sorted(v, key=lambda e: e[0].encode()) for k, v in entries.items()
        }
        for page_list in found.values():
            assert all(len(page) == size for page in page_list[:-1]) and 0 < len(page_list[-1]) <= size


def test_a_run_leaves_nothing_behind(spark):
    before = session.scratch(spark)
    with session.own_scratch(spark):
        folder = session.scratch(spark).removeprefix("file:")
        assert session.store(spark.range(3)).count() == 3 and os.listdir(folder)
    assert not os.path.exists(folder)
    assert session.scratch(spark) == before
