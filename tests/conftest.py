import datetime
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rekit.session import tune  # noqa: E402
from rekit.sources.schema import SCHEMAS  # noqa: E402
from rekit.sources.tables import Tables  # noqa: E402

DAY = datetime.date(2020, 5, 17)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("rekit-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Tables from rows given per table, as dicts; missing columns get defaults."""
    defaults = {
        "stock": dict(
            serial_id=None,
            stock_type=2,
            inventory_type=3,
            location_type=1,
            location_id=370,
            container_type=1,
            container_id=None,
            quantity_on_hand=1,
            quantity_available=1,
        ),
        "product": dict(product_number=None, edi_number=None, description=None),
        "product_component": dict(quantity=1),
        "product_serial": {},
        "bin": dict(zone="G1", position="01", shelf="A"),
        "daily_snapshot": dict(
            warehouse_id="E01", on_hand=0, on_reserve=0, unavailable=0, snapshot_dte=DAY
        ),
    }

    def build(storing=True, **rows):
        def load(name):
            names = SCHEMAS[name].fieldNames()
            full = [defaults[name] | row for row in rows.get(name, [])]
            return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMAS[name])

        return Tables(spark, load, as_of=DAY, storing=storing)

    return build


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples; NULLs sort first."""

    def collect(df, *columns):
        found = [tuple(r) for r in df.select(*columns or df.columns).collect()]
        return sorted(found, key=lambda r: [(v is not None, v) for v in r])

    return collect
