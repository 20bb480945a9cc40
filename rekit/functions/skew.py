"""Work inside a group without ever putting the whole group into one task.

A single kit may own a large share of all serials or of all components. Ranks and
running sums are therefore computed in blocks of bounded size plus one small
frame of block totals, and many-to-many joins on a kit are cut into tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rekit.session import store

# A block holds at most 2**RANK_BITS distinct values of a group.
RANK_BITS = 22
# A tile joins about TILE_SIDE rows with TILE_SIDE rows of one key.
TILE_SIDE = 2_000
# Output rows per task of a join that multiplies rows.
ROWS_PER_TASK = 1_000_000
# Entries of a list that stands for so many rows, about.
PIECE = 64


def rank_in_group(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``row_number() over (partition by group order by value)`` for bigint values
    that are distinct within a group.

    The upper bits of the value name a block. Distinct values bound every window:
    a block has at most 2**RANK_BITS rows, a region as many blocks, and what is left
    of a 64-bit value names at most 2**20 regions.
    """
    bits, block, region = RANK_BITS, "_block", "_region"
    rows = df.withColumn(block, F.shiftright(value, bits))
    counts = (
        rows.groupBy(group, block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(region, F.shiftright(block, bits))
    )
    regions = counts.groupBy(group, region).agg(F.sum("_n").alias("_n"))
    regions = regions.select(
        group, region, _sum_before("_n", [group], F.col(region)).alias("_region_start")
    )
    starts = (
        counts.withColumn("_block_start", _sum_before("_n", [group, region], F.col(block)))
        .join(regions, [group, region])
        .select(group, block, (F.col("_region_start") + F.col("_block_start")).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy(group, block).orderBy(value))
    return (
        rows.join(starts, [group, block])
        .withColumn(out, F.col("_start") + within)
        .drop(block, "_start")
    )


def _sum_before(column: str, group: list[str], order: Column) -> Column:
    window = (
        Window.partitionBy(*group)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    return F.coalesce(F.sum(column).over(window), F.lit(0).cast("long"))


def joined_rows(left: DataFrame, right: DataFrame, key: str) -> int:
    """Rows that joining on the key gives, from the counts of ``heavy_keys``."""
    return total_rows(left.join(right, key))


def total_rows(sizes: DataFrame) -> int:
    """Rows that the keys of ``sizes`` (left_rows, right_rows) give together."""
    pairs = F.col("left_rows").cast("double") * F.col("right_rows")
    return int(sizes.agg(F.sum(pairs)).first()[0] or 0)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Partition one side of a join by its keys, for the rows that come out of it.

    Spark sizes tasks by what goes into a join. Where a few bytes in become many rows
    out, that makes too few of them. The keys name tiles or blocks of bounded output, so
    no task depends on a hot key being split later.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, rows // ROWS_PER_TASK), *keys)


def heavy_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose join outgrows one tile, with the number of tiles along each side.

    ``left`` and ``right`` have per key the number of rows (``left_rows``,
    ``right_rows``). A key that is not in the result is joined as a single tile.
    """
    side = TILE_SIDE
    pairs = F.col("left_rows").cast("double") * F.col("right_rows")
    return (
        left.join(right, key)
        .where(pairs > float(side) * side)
        .select(
            key,
            F.ceil(F.col("left_rows") / side).cast("long").alias("_left_tiles"),
            F.ceil(F.col("right_rows") / side).cast("long").alias("_right_tiles"),
        )
    )


def tile_rows(df: DataFrame, heavy: DataFrame, key: str, side: str, *by: str) -> DataFrame:
    """Add the tile columns ``_lt`` and ``_rt`` to one side (left or right) of a join.

    A row has one position along its own side, decided by the columns ``by``, which
    should tell the rows of a key apart. It belongs to every tile along the other side
    and is copied there; the copies of a row are about 1/TILE_SIDE of what it joins with.
    """
    df = df.join(heavy, key, "left")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tiles = {
        "left": F.coalesce("_left_tiles", one),
        "right": F.coalesce("_right_tiles", one),
    }
    own, other = ("_lt", "_rt") if side == "left" else ("_rt", "_lt")
    across = tiles["right" if side == "left" else "left"]
    return (
        df.withColumn(own, F.pmod(F.xxhash64(*by), tiles[side]))
        .withColumn(other, F.explode(F.sequence(zero, across - 1)))
        .drop("_left_tiles", "_right_tiles")
    )


#: The axes of a box, and how many shares a heavy key has along each.
BOX = {"_lt": "_left_tiles", "_rt": "_right_tiles", "_bt": "_bin_tiles"}


def in_pieces(df: DataFrame, group: list[str], entry: Column, by: list[str], out: str) -> DataFrame:
    """Rows of a group as lists ``out`` of about ``PIECE`` entries, numbered ``<out>_piece``.

    ``by`` tells the rows of a group apart. A group is counted in one task, so it must have a
    natural bound, such as the number of bins in a warehouse.
    """
    pieces = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*group)) / PIECE)
    return (
        df.withColumn(f"{out}_piece", F.pmod(F.xxhash64(*by), pieces))
        .groupBy(*group, f"{out}_piece")
        .agg(F.collect_list(entry).alias(out))
    )


def heavy_boxes(sizes: DataFrame, key: str) -> DataFrame:
    """As ``heavy_keys``, for a right side whose rows stand for many.

    ``sizes`` has per key the rows of the left side (``left_rows``), the rows that those of the
    right side stand for (``right_rows``), the most that one item has (``most_rows``) and the
    pieces that these are held in (``pieces``). An item that outgrows a tile has shares of its
    pieces along a third axis; items are dealt out along the second one.
    """
    side = TILE_SIDE
    pairs = F.col("left_rows").cast("double") * F.col("right_rows")
    one = F.lit(1).cast("long")
    shares = F.greatest(one, F.least(F.ceil(F.col("most_rows") / side), F.col("pieces")))
    return (
        sizes.where(pairs > float(side) * side)
        .withColumn("_bin_tiles", shares.cast("long"))
        .select(
            key,
            F.ceil(F.col("left_rows") / side).cast("long").alias("_left_tiles"),
            F.ceil(F.col("right_rows") / (F.col("_bin_tiles") * side)).cast("long").alias("_right_tiles"),
            "_bin_tiles",
        )
    )


def box_rows(df: DataFrame, heavy: DataFrame, key: str, **at: Column) -> DataFrame:
    """Add the columns of ``BOX`` to one side of a join: along the axes ``at`` a row has one
    place, decided by the hash given; along the others it is copied to every share."""
    df = df.join(heavy, key, "left")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    for axis, shares in BOX.items():
        count = F.coalesce(shares, one)
        place = F.pmod(at[axis], count) if axis in at else F.explode(F.sequence(zero, count - 1))
        df = df.withColumn(axis, place)
    return df.drop(*BOX.values())


def positioned(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """The rows with their places in the order, from 1; equal in ``order``, by all columns.

    Ranges of the order are sorted by a task each; what comes before a range is added up
    over the ranges, of which there are as many as tasks. The sorted rows are stored, so each
    keeps its place.
    """
    ties = [F.asc_nulls_first(c) for c in df.columns]
    rows = store(df.orderBy(*order, *ties).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits name the task, the lower 33 count within it.
    task, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_task", task)
    counts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_task", _sum_before("_n", [], F.col("_task")).alias("_before"))
    return rows.join(before, "_task").select(*df.columns, (F.col("_before") + place + 1).alias(out))
