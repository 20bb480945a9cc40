"""Hot kits, serials and stock rows: same results, and no task with the whole group."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rekit.functions import skew
from rekit.operators import breakout, corrected, inventory, reassembly, standard
from rekit.sources.tables import Tables
from tests.test_report_random import Check, same, warehouse


@pytest.fixture
def sql_conf(spark):
    """Set session options for one test."""
    before = {}

    def set_all(**options):
        for key, value in options.items():
            name = "spark.sql." + key.replace("__", ".")
            before[name] = spark.conf.get(name, None)
            spark.conf.set(name, value)

    yield set_all
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run(df):
    """Execute and return the final plan."""
    df.write.format("noop").mode("overwrite").save()
    frame = df._jdf.queryExecution()
    df.collect()
    return frame.executedPlan().toString()


@pytest.mark.parametrize("bits", [1, 3, 22])
def test_rank_in_group(spark, monkeypatch, bits):
    monkeypatch.setattr(skew, "RANK_BITS", bits)
    values = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"),
        # spread over the whole range of a bigint, negative ones included
        F.when(F.col("id") % 2 == 0, F.col("id") - 700).otherwise(F.xxhash64("id")).alias("v"),
    )
    values = values.distinct()
    ranked = skew.rank_in_group(values, "g", "v", "pos")
    expected = values.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    assert set(ranked.columns) == {"g", "v", "pos"}
    columns = ["g", "v", "pos"]
    assert ranked.select(columns).exceptAll(expected.select(columns)).count() == 0
    assert ranked.count() == expected.count()


@pytest.mark.parametrize("seed", [1])
def test_reports_in_tiny_tiles(spark, make_tables, monkeypatch, seed):
    """Every kit with more than one row is cut into tiles along both sides."""
    monkeypatch.setattr(skew, "TILE_SIDE", 1)
    tables = make_tables(**warehouse(seed))
    check = Check(tables)
    for name, operator in (
        ("serial_kit_grid", breakout.serial_kit_grid),
        ("kit_breakout", breakout.kit_breakout),
    ):
        same(operator(tables), check(name))


def test_heavy_keys(spark):
    left = spark.createDataFrame([("a", 9000), ("b", 10), ("c", 1)], "k string, left_rows bigint")
    right = spark.createDataFrame(
        [("a", 40), ("b", 10), ("c", 9_000_000)], "k string, right_rows bigint"
    )
    heavy = {r.k: (r._left_tiles, r._right_tiles) for r in skew.heavy_keys(left, right, "k").collect()}
    assert heavy == {"c": (1, 4500)}
    more = left.withColumn("left_rows", F.col("left_rows") * 100)
    heavy = {r.k: (r._left_tiles, r._right_tiles) for r in skew.heavy_keys(more, right, "k").collect()}
    assert heavy == {"a": (450, 1), "c": (1, 4500)}


def test_heavy_boxes(spark):
    """A kit of one row, one of 3,000 components with 300 bins of each kind, one of a single
    component that stands for most of its rows."""
    sizes = spark.createDataFrame(
        [("one", 1, 1, 1, 1), ("wide", 10, 3_000 * 90_000, 90_000, 25), ("deep", 4_000, 1_000_000, 900_000, 400)],
        "k string, left_rows bigint, right_rows bigint, most_rows bigint, pieces bigint",
    )
    found = {r.k: (r._left_tiles, r._right_tiles, r._bin_tiles) for r in skew.heavy_boxes(sizes, "k").collect()}
    assert found == {"wide": (1, 5_400, 25), "deep": (2, 2, 400)}


def test_lists_in_pieces(spark):
    rows = spark.range(5_000).selectExpr("if(id < 4900, 'hot', 'g' || id) as g", "id as v")
    found = skew.in_pieces(rows, ["g"], F.col("v"), ["v"], "vs").collect()
    sizes = [len(r.vs) for r in found if r.g == "hot"]
    assert sum(sizes) == 4_900 and len(sizes) > 70 and max(sizes) < 2 * skew.PIECE
    assert sorted(v for r in found for v in r.vs) == list(range(5_000))


class Wide:
    """One kit of 3,000 components, each in 300 bins of loose pieces, in 300 kit bins."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, name):
        from rekit.sources.schema import SCHEMAS

        spark, site, nothing = self.spark, ["3", "1", "370L"], "cast(null as bigint)"
        if name == "stock":
            units = spark.range(300).selectExpr(
                "id", "1000000", "id", "4", *site, "1", "id", "1L", "1L"
            )
            contents = spark.range(3_000).selectExpr(
                "10000000 + id", "id", nothing, "2", *site, "2", "id % 300", "1L", "1 + id % 3"
            )
            loose = spark.range(900_000).selectExpr(
                "20000000 + id", "id % 3000", nothing, "1", *site, "1", "1000 + id div 3000", "1L", "1L"
            )
            frame = units.union(contents).union(loose)
        elif name == "product":
            frame = spark.range(3_000).selectExpr("id", "'C-' || id", "cast(id as string)", "'part'").union(
                spark.range(1).selectExpr("1000000", "'K'", "'E'", "'kit'")
            )
        elif name == "product_component":
            frame = spark.range(3_000).selectExpr("1000000", "id", "2L")
        elif name == "product_serial":
            frame = spark.range(300).selectExpr("id", "id")
        elif name == "bin":
            frame = spark.range(2_000).selectExpr(
                "id", "if(id < 1000, 'G', 'R')", "cast(id as string)", "'A'"
            )
        else:
            frame = spark.range(0).selectExpr("'1'", "'E01'", "id", "1L", "0L", "date'2020-05-17'")
        return frame.toDF(*SCHEMAS[name].fieldNames())


def test_bins_of_both_kinds_fan_out_in_boxes(spark):
    """81 billion report rows, from a million rows at most: no box stands for more than a few
    tiles' worth, and the counts don't need the rows."""
    from tests.conftest import DAY

    tables = Tables(spark, Wide(spark), as_of=DAY)
    report = breakout._report(tables)
    rows = report.components.selectExpr("size(loose) l", "size(bins) b").selectExpr(
        "count(*)", "sum(l * b)", "max(l * b)"
    ).first()
    assert rows[1] == 3_000 * 300 * 300 and rows[0] < 3_000 * 60 and rows[2] < 4 * skew.PIECE**2
    serials = breakout._repeat(report.serials).withColumnRenamed("kit_number", "kit_product_number")
    serials = serials.where("serial_number < 2")
    sizes = report.sizes()
    assert skew.total_rows(sizes) == 300 * 3_000 * 300 * 300
    serials, components = breakout._placed(report, serials, sizes)
    box = ["_lt", "_rt", "_bt"]
    per_box = components.groupBy(*box).agg(F.sum(F.size("loose") * F.size("bins")).alias("n"))
    most, whole = per_box.agg(F.max("n"), F.sum("n")).first()
    tile = skew.TILE_SIDE * skew.PIECE
    assert whole == 3_000 * 300 * 300 and most < tile
    assert serials.groupBy("serial_number").count().select("count").distinct().collect() == [
        (sizes.first()["right_rows"] // skew.TILE_SIDE,)
    ]
    missing = breakout.pieces_missing(tables).where("serial_number = 7").first()
    held = sum(1 + i % 3 for i in range(7, 3_000, 300))
    assert missing.pieces_missing == (3_000 * 2 - held) * 300 * 300


def test_places_in_an_order(spark):
    rows = spark.range(4_000).selectExpr("if(id % 3 = 0, null, id % 40) as a", "id % 7 as b")
    placed = skew.positioned(rows, F.desc_nulls_first("a")).collect()
    key = lambda r: (r.a is not None, -(r.a or 0), r.a is not None, r.a or 0, r.b)
    assert [r.position for r in sorted(placed, key=lambda r: r.position)] == list(range(1, 4_001))
    ordered = sorted(placed, key=lambda r: r.position)
    assert [key(r) for r in ordered] == sorted(key(r) for r in placed)
    assert skew.positioned(rows.limit(0), F.col("a")).collect() == []


def test_every_heavy_key_is_found(spark):
    """However many there are, none is left to a single task."""
    counts = spark.range(5_000).selectExpr("id as k", "10000L as left_rows")
    other = spark.range(5_000).selectExpr("id as k", "if(id < 1500, 1000L, 1L) as right_rows")
    assert skew.heavy_keys(counts, other, "k").count() == 1_500


def test_rows_that_share_a_value_are_told_apart(spark):
    """Components with the same or no edi fill all tiles."""
    rows = spark.range(4_000).selectExpr("1 as k", "cast(null as string) as edi", "'C-' || id as number")
    heavy = spark.createDataFrame([(1, 1, 10)], "k int, _left_tiles bigint, _right_tiles bigint")
    tiles = skew.tile_rows(rows, heavy, "k", "right", "number", "edi").groupBy("_rt").count().collect()
    assert len(tiles) == 10 and max(r["count"] for r in tiles) < 600


def test_build_lines_of_a_kit_are_cut_along_both_sides(spark):
    """3,600 serials by 2,800 components of one kit: no task has most of the lines."""
    fill = spark.range(2_800).selectExpr(
        "'K' as kit_number", "'C-' || id as component", "1L as std_qty", "3600L as fill"
    )
    slots = spark.range(3_600).selectExpr("'K' as kit_number", "id as serial_number", "id + 1 as build_pos")
    lines = reassembly.assembly_build_lines(fill, slots, 3_600 * 2_800)
    per_task = lines.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 3_600 * 2_800
    assert max(r["count"] for r in per_task) <= 3_600 * 2 * reassembly.LINE_COMPONENTS
    assert lines.select("serial_number", "component").distinct().count() == 3_600 * 2_800


def test_the_corrected_report_in_tiny_tiles(make_tables, monkeypatch, rows):
    tables = make_tables(**warehouse(3))
    whole = rows(corrected.kit_breakout_corrected(tables))
    monkeypatch.setattr(skew, "TILE_SIDE", 1)
    assert rows(corrected.kit_breakout_corrected(tables)) == whole
    assert whole


class Hot:
    """A warehouse from ranges: a third of the contents in one unit, a third of the
    units in one bin and of one kit, a third of the loose pieces of one product."""

    def __init__(self, spark, n):
        self.spark, self.n = spark, n

    def __call__(self, name):
        from rekit.sources.schema import SCHEMAS

        n, spark = self.n, self.spark
        kit = "case when id % 3 = 0 then 0 else id % 50 end"
        nothing = "cast(null as bigint)"
        site = ["3", "1", "370L"]
        if name == "stock":
            units = spark.range(n // 4).selectExpr(
                "id", f"1000000 + {kit}", "id", "cast(3 + id % 2 as int)", *site, "1", kit, "1L", "1L"
            )
            contents = spark.range(n).selectExpr(
                "10000000 + id",
                "id % 20",
                nothing,
                "2",
                *site,
                "2",
                f"case when id % 3 = 0 then 0 else id % {n // 4} end",
                "1L",
                "id % 3",
            )
            loose = spark.range(n).selectExpr(
                "20000000 + id",
                "case when id % 3 = 0 then 0 else id % 1000 end",
                nothing,
                "1",
                *site,
                "1",
                "100 + id % 7",
                "1L",
                "1 + id % 5",
            )
            frame = units.union(contents).union(loose)
        elif name == "product":
            frame = spark.range(1000).selectExpr(
                "id", "'C-' || id", "cast(id as string)", "'part'"
            ).union(
                spark.range(50).selectExpr("1000000 + id", "'K-' || id", "'E' || id", "'kit'")
            )
        elif name == "product_component":
            frame = spark.range(1000).selectExpr("1000000 + id % 50", "id div 50", "1L")
        elif name == "product_serial":
            frame = spark.range(n // 4).selectExpr("id", "id")
        elif name == "bin":
            frame = spark.range(200).selectExpr(
                "id", "if(id < 100, 'G', 'R')", "cast(id as string)", "'A'"
            )
        else:
            frame = spark.range(1000).selectExpr(
                "cast(id % 20 as string)", "'E01'", "id", "1L", "0L", "date'2020-05-17'"
            )
        return frame.toDF(*SCHEMAS[name].fieldNames())


@pytest.fixture
def hot(spark):
    from tests.conftest import DAY

    return Tables(spark, Hot(spark, 40_000), as_of=DAY)


def test_hot_keys_are_split_at_run_time(hot, sql_conf):
    """With partitions of a few kilobytes standing in for big ones, the joins on a hot
    key are executed in several tasks, and the results stay the same."""
    operators = (
        inventory.serial_contents,
        inventory.loose_availability,
        inventory.kit_units,
    )
    hot = hot.with_settings(storing=False)
    plain = [operator(hot).groupBy().count().first()[0] for operator in operators]
    sql_conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="8kb",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16kb",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__coalescePartitions__enabled="false",
        shuffle__partitions="16",
    )
    for operator, expected in zip(operators, plain):
        df = operator(hot.with_settings())
        plan = run(df)
        assert "skew=true" in plan, operator.__name__
        assert df.count() == expected


def test_a_kit_with_most_of_the_bill_is_split(make_tables, spark, sql_conf):
    """Its bill rows are spread over tasks although the kit is on the short side."""
    base = make_tables(**warehouse(0))
    bills = spark.range(60_000).selectExpr(
        "if(id % 3 < 2, 1000, 2000 + id) as product_id", "id % 9 as component_product_id", "id as quantity"
    )

    def load(name):
        return bills if name == "product_component" else getattr(base, name)

    tables = Tables(spark, load, as_of=base.as_of)
    expected = standard.kit_standard_size(tables).collect()
    sql_conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__advisoryPartitionSizeInBytes="8kb",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="16kb",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__coalescePartitions__enabled="false",
    )
    df = standard.kit_standard_size(tables)
    assert "skew=true" in run(df)
    assert sorted(df.collect()) == sorted(expected)
    assert ("K-1", 40_000) in expected


def test_a_hot_kit_is_cut_into_tiles(hot, monkeypatch):
    """One kit has a third of all serials: its part of the grid is spread evenly."""
    monkeypatch.setattr(skew, "TILE_SIDE", 50)
    grid = breakout.serial_kit_grid(hot)
    seen = {}

    def tiles(df, heavy, key, side, *by, original=skew.tile_rows):
        seen[side] = original(df, heavy, key, side, *by)
        return seen[side]

    monkeypatch.setattr(breakout, "tile_rows", tiles)
    assert breakout.serial_kit_grid(hot).count() == grid.count() == 20 * 10_000
    per_tile = (
        seen["left"]
        .where("kit_product_number = 'K-0'")
        .groupBy("_lt", "_rt")
        .count()
        .agg(F.count("*"), F.max("count"), F.sum("count"))
        .first()
    )
    assert per_tile[0] > 20 and per_tile[1] < per_tile[2] / 10
