"""Helpers shared by the operators: shared storage, column handling, text expressions."""

from __future__ import annotations

import gc
import os
import shutil
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words: space and the ASCII control characters tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A word, as the contracts of the operators define it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    Where all of Spark is one process and none is named, the warehouse serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when Spark ends."""
    context = spark.sparkContext
    if getattr(context, "_llm_scratch", None) is None:
        path = f"{shared_dir(spark)}/llm/{context.applicationId}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        context._llm_scratch = path
    return context._llm_scratch


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    ``options`` are the writer's. It is then computed once, outlives a lost executor, and Spark knows its size when it
    plans a join.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark drops an execution's shuffle files when it ends, not when the driver next collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_in_turn(frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of frames of one schema, stored one after the other.

    Each one's shuffle leaves the disk before the next begins; a frame that is made again
    later shuffles again.
    """
    frames = list(frames)
    spark = frames[0].sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        for frame in frames:
            frame.write.mode("append").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(frames[0].schema).parquet(path)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns that an operator's own columns replace; letter case doesn't matter."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    """A top-level column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_az(text: Column) -> Column:
    """Lower-case A to Z and nothing else.

    ``lower`` does just that, and faster, where the text has only ASCII characters.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` of a folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch, about, unless the session says otherwise: texts may be long.
BATCH_BYTES = 4 << 20


def shipped(df: DataFrame) -> DataFrame:
    """The frame, after making sure that executors can import this package and get their
    rows in batches of bounded size."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not getattr(context, "_llm_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="llm-"), "llm"), "zip", os.path.dirname(here), "llm"
        )
        context.addPyFile(archive)
        context._llm_shipped = True
    return df


def in_batches(
    df: DataFrame, name: str, function: Callable[[pa.Array], list[pa.Array]], fields: str
) -> DataFrame:
    """``df`` with the column ``name`` replaced by the columns that ``function`` makes of it.

    ``function`` gets the column a batch at a time. Columns go by their place, as names may
    hold dots; other columns named like one of ``fields`` are replaced.
    """
    made = StructType.fromDDL(fields)
    taken = {f.lower() for f in made.fieldNames()} - {name.lower()}
    df = without(df, taken)
    at = df.columns.index(name)
    places = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    schema = StructType([*(f for i, f in enumerate(places.schema.fields) if i != at), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.record_batch([*columns, *function(batch.column(at))], names=schema.fieldNames())

    rows = shipped(places).mapInArrow(run, schema)
    return rows.toDF(*[c for i, c in enumerate(df.columns) if i != at], *made.fieldNames())


_in_worker: dict = {}


def in_worker(make: Callable, *args):
    """What ``make`` gives for ``args``, kept from task to task until another thing is asked for.

    A Python worker serves the tasks of one operator after another. It keeps a single thing
    at a time, so that what an operator has learnt doesn't take memory from the next one.
    """
    key = (make, args)
    if key not in _in_worker:
        if _in_worker:
            _in_worker.clear()
            gc.collect()  # what goes may refer to itself
        _in_worker[key] = make(*args)
    return _in_worker[key]


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The bytes of each text or binary value; null is empty."""
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]
