"""The two parameterized reports as SQL table functions over a store laid out by kit."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rekit.operators.breakout import REPORT_ORDER, join_parts, report_parts
from rekit.operators.standard import kit_standard
from rekit.session import scratch
from rekit.sources.tables import Tables

#: Shares of the store; a call reads the files of one.
BUCKETS = 256
#: What the store holds, by the column with the kit's number.
PARTS = {
    "standard": "kit_number",
    "serials": "kit_product_number",
    "components": "kit_product_number",
    "contents": "kit_product_number",
}

_BUCKET = "kit_bucket"
_STANDARD_ORDER = "kit_number ASC NULLS LAST, product_number ASC NULLS LAST"


def _bucket(kit: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kit), F.lit(buckets)).cast("int")


def write_store(tables: Tables, path: str, buckets: int = BUCKETS) -> None:
    """Write the parts of both reports below ``path``, a folder per share of the kits.

    Within a share rows are sorted by kit, and a share that is large has several files, so that a
    hot kit is neither written nor read by one task. Rows without a kit are in no report of a kit.
    """
    frames = {"standard": kit_standard(tables)} | report_parts(tables)
    for name, kit in PARTS.items():
        rows = frames[name].where(F.col(kit).isNotNull()).withColumn(_BUCKET, _bucket(F.col(kit), buckets))
        rows.hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, kit).write.mode("overwrite").partitionBy(
            _BUCKET
        ).parquet(f"{path}/{name}")
    # Written last: a store with it is whole.
    tables.spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def register_store(spark: SparkSession, path: str) -> None:
    """Create ``kit_std_breakout(kit)`` and ``kit_breakout(kit)`` for this session, over a store.

    The kit number is a function argument, never part of the SQL text. Its share of the
    store is worked out from it while the query is planned, so only files of that share are
    listed and read; the comparison with the kit reaches every part through the joins. A call
    sees the tables as they were when the store was written.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
    standard = parts.pop("standard")
    report = join_parts(parts, _BUCKET)
    directions = {F.desc_nulls_first: "DESC NULLS FIRST", F.asc_nulls_last: "ASC NULLS LAST"}
    order = ", ".join(f"{column} {directions[d]}" for column, d in REPORT_ORDER.items())
    _create("kit_std_breakout", standard, PARTS["standard"], buckets, _STANDARD_ORDER)
    _create("kit_breakout", report, PARTS["components"], buckets, order)


def _create(function: str, rows: DataFrame, kit: str, buckets: int, order: str) -> None:
    view = f"rekit_{function}"
    rows.createOrReplaceTempView(view)
    fields = [f for f in rows.schema if f.name != _BUCKET]
    returns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    rows.sparkSession.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(kit STRING) RETURNS TABLE({returns}) "
        f"RETURN SELECT {', '.join(f.name for f in fields)} FROM {view} "
        f"WHERE {_BUCKET} = CAST(pmod(xxhash64({function}.kit), {buckets}) AS INT) "
        f"AND {kit} = {function}.kit ORDER BY {order}"
    )


def register(tables: Tables, path: str | None = None) -> None:
    """Write the store, below ``path`` or in the application's own folder, and create the
    functions over it."""
    path = path or f"{scratch(tables.spark)}/store-{uuid.uuid4().hex}"
    write_store(tables, path)
    register_store(tables.spark, path)
