"""Session settings the jobs rely on."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

# Read at planning time, so they can be set on a running session.
RECOMMENDED = {
    # Dates in the snapshot filter must not shift with the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when the split costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above; what was set when the application started wins."""
    at_start = dict(spark.sparkContext.getConf().getAll())
    for key, value in RECOMMENDED.items():
        if key not in at_start:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where all of Spark is one process and none is
    named, the warehouse serves; on a cluster a folder must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when Spark ends."""
    context = spark.sparkContext
    if getattr(context, "_rekit_scratch", None) is None:
        path = f"{checkpoint_dir(spark)}/rekit/{context.applicationId}-{uuid.uuid4().hex[:8]}"
        files, folder = _files(spark, path)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        context._rekit_scratch = path
    return context._rekit_scratch


def clean(spark: SparkSession) -> None:
    """Delete what this application stored, at the end of a run. Frames that read it are
    gone with it."""
    context = spark.sparkContext
    if getattr(context, "_rekit_scratch", None) is not None:
        files, folder = _files(spark, context._rekit_scratch)
        files.delete(folder, True)
        context._rekit_scratch = None


@contextlib.contextmanager
def own_scratch(spark: SparkSession):
    """Store what is stored meanwhile in a folder of its own, and delete it at the end."""
    context = spark.sparkContext
    before = getattr(context, "_rekit_scratch", None)
    context._rekit_scratch = None
    try:
        yield
    finally:
        clean(spark)
        context._rekit_scratch = before


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds."""
    files, place = _files(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(place)]


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old text or the new one, nothing between."""
    files, place = _files(spark, path)
    fresh = place.suffix(f".{uuid.uuid4().hex}")
    stream = files.create(fresh)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(place.makeQualified(files.getUri(), place).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(fresh), files.makeQualified(place), options)


def store(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For frames that several parts of a plan need: they are computed once instead of
    once per use, a lost executor costs no recomputation, and later joins know their
    size.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
