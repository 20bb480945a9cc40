"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, lower_az, quoted, stored, without

PREFIX_CHARS = 256

_ROW, _LENGTH, _PREFIX, _FULL, _HIT = "_xd_row", "_xd_length", "_xd_prefix", "_xd_full", "_xd_hit"


def shared_prefixes(keyed: DataFrame) -> DataFrame:
    """(length, prefix hash) pairs that more than one row has, lengths refined first.

    ``keyed`` has one narrow row per document: length and prefix hash. A length that
    occurs once ends there; only rows of the other lengths are grouped by prefix.
    """
    lengths = keyed.groupBy(_LENGTH).count().where("count > 1").select(_LENGTH)
    # Rows of one length and prefix are counted where they are read, before the join on
    # length: copies of one text don't meet in a task.
    return (
        keyed.groupBy(_LENGTH, _PREFIX)
        .count()
        .join(lengths, _LENGTH, "left_semi")
        .where("count > 1")
        .select(_LENGTH, _PREFIX, F.lit(True).alias(_HIT))
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical after lower-casing A to Z; null counts as empty. The
    row with the largest id stays. Full texts are hashed only for rows that share length
    and prefix hash with another row. The list of those pairs is stored, so Spark knows
    its size: it is broadcast below Spark's limit, otherwise the join shuffles.

    Defined cases: a null id is smaller than any other; of rows that are equal in id and
    text one stays, whichever was read last; an empty table gives an empty result; columns
    of ``docs`` named like a result column are replaced, others pass through.
    """
    docs = without(docs, ["keep_id", "group_size", "kept"])
    text = lower_az(F.coalesce(quoted(text_col), F.lit("")))
    keys = {
        _LENGTH: F.octet_length(text),
        _PREFIX: F.xxhash64(lower_az(F.substring(F.coalesce(quoted(text_col), F.lit("")), 1, prefix_chars))),
    }
    pairs = stored(shared_prefixes(stored(docs.select(*[c.alias(n) for n, c in keys.items()]))))
    rows = (
        docs.withColumn(_ROW, F.monotonically_increasing_id())
        .withColumns(keys)
        .join(pairs, [_LENGTH, _PREFIX], "left")
        .withColumn(
            # A row without a possible partner gets a key of its own kind, never null: null
            # keys would all meet in one task.
            _FULL,
            F.when(quoted(_HIT), F.sha2(text, 256)).otherwise(
                F.concat_ws(":", quoted(_LENGTH), quoted(_PREFIX), quoted(_ROW))
            ),
        )
    )
    hits = rows.where(quoted(_HIT))
    groups = hits.groupBy(_FULL).agg(
        F.max(F.struct(quoted(id_col).alias("id"), quoted(_ROW).alias("row"))).alias("_xd_keep"),
        F.count("*").alias("_xd_size"),
    )
    joined = rows.join(groups, _FULL, "left")
    return joined.select(
        *[quoted(c) for c in docs.columns],
        F.when(F.col("_xd_size").isNull(), quoted(id_col)).otherwise(F.col("_xd_keep.id")).alias("keep_id"),
        F.coalesce("_xd_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_xd_size").isNull() | (F.col("_xd_keep.row") == quoted(_ROW))).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    flagged = exact_dedup(docs, id_col, text_col)
    return flagged.where("kept").select(*[quoted(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    digest = F.sha2(lower_az(F.coalesce("text", F.lit(""))), 256)
    found = exact_dedup(docs.select("doc_id", "text", digest.alias("text_sha256")))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH t AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
