"""Removing repeated passages: strings of a least length that start more than once.

The method is interval expansion on a Burrows-Wheeler transform: all suffixes at the same
depth take one step backward together, in the order that the transform's column of
preceding bytes gives them, and the common prefixes of neighbours follow from those of
the step before. A passage counts once its common prefix reaches the least length.

To spread this over a cluster, every string of the least length is sent where its anchor
leads: the substring with the smallest hash in it. Equal strings have equal anchors, so
they meet; the suffixes of a group all start at the anchor, which keeps them in step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, quoted, shipped, stored, without
from llm.hashing import Hashes, digest, mixed, raw

#: Bytes of a string that counts, bytes of an anchor.
LEAST, ANCHOR = 400, 64
#: Bytes that are worked on at once; members of groups that are expanded at once.
CHUNK, MEMBERS = 1 << 20, 20_000

_PLACE_BITS = 22  # places within a chunk and what its last strings reach


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by blocks' running minima."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(data: np.ndarray, ends: np.ndarray, least: int, anchor: int) -> dict[str, np.ndarray]:
    """Strings of ``least`` bytes in texts that end at ``ends``, as runs with one anchor.

    A run is a stretch of starts whose strings have their anchor at the same place, on one
    side: the anchor begins at most half way (near) or later (far) in the string. ``base``
    is the anchor for near runs and half way before it for far ones, so that all strings
    of a run hold the bytes behind ``base`` that ``key`` is the hash of. ``left``, ``right``:
    bytes of the run's strings before and from ``base`` on. ``content``: digest of all, which
    runs of a key are equal by.
    """
    empty = {n: np.empty(0, np.int64) for n in ("base", "left", "right", "key", "content")}
    n, width = len(data), least - anchor + 1
    if n < least:
        return empty
    with np.errstate(over="ignore"):
        hashes = Hashes(data)
        places = np.arange(n - anchor + 1)
        # Smallest hash first, then leftmost.
        ranked = (hashes.of(places, places + anchor) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places.astype(np.uint64)
        at = (window_minima(ranked, width) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(at))
        text = np.searchsorted(ends, starts, "right")
        fits = starts + least <= ends[text]
        starts, at, text = starts[fits], at[fits], text[fits]
        if not len(starts):
            return empty
        half = (least - anchor) // 2
        far = at - starts > half
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (far[1:] != far[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        far = far[first]
        base = at[first] - np.where(far, half + 1, 0)
        begin, stop = starts[first], starts[last] + least
        shared = np.where(far, half + 1 + anchor, least - half)
        key = mixed(hashes.of(base, base + shared) + far.astype(np.uint64))
        whole = memoryview(data)
        content = np.fromiter((digest(whole[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)), np.uint64, len(begin))
        content = mixed(content + (base - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return {
        "base": base,
        "left": base - begin,
        "right": stop - base,
        "key": key.astype(np.int64),
        "content": content.astype(np.int64),
    }


def _cuts(sizes: list[int], least: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lots of (text, from, to) of about CHUNK bytes; parts of one text overlap so that
    every string lies whole in one."""
    lot, held = [], 0
    for i, size in enumerate(sizes):
        for start in range(0, max(1, size - least + 1), CHUNK):
            part = (i, start, min(size, start + CHUNK + least - 1))
            lot.append(part)
            held += part[2] - part[1]
            if held >= CHUNK:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def _entries(batches: Iterator[pa.RecordBatch], least: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = raw(batch.column("text")), batch.column("row").to_numpy()
        for lot in _cuts([len(t) for t in texts], least):
            parts = [np.frombuffer(texts[i][a:b], np.uint8) for i, a, b in lot]
            ends = np.cumsum([len(p) for p in parts])
            runs = anchored_runs(np.concatenate(parts), ends, least, anchor)
            which = np.searchsorted(ends, runs["base"] - runs["left"], "right")
            offset = np.array([a for _, a, _ in lot]) - np.concatenate([[0], ends[:-1]])
            yield pa.record_batch(
                [
                    pa.array(runs["key"]),
                    pa.array(runs["content"]),
                    pa.array(rows[np.array([i for i, *_ in lot])[which]]),
                    pa.array(runs["base"] + offset[which]),
                    pa.array((runs["left"] << 32) | runs["right"]),
                ],
                names=["key", "content", "row", "base", "sides"],
            )


def _prefixes(texts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before, 0 between groups."""
    differ = texts[1:] != texts[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    return np.concatenate([[0], np.where(group[1:] == group[:-1], common, 0)])


def expand(
    group: np.ndarray, lefts: list[bytes], rights: list[bytes], least: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each member the fewest and most steps back at which its string of ``least``
    bytes occurs again in its group; the most is -1 where it never does.

    Members stand in suffix order of their right sides. One step back reads the column of
    bytes before them: a stable sort by byte gives the next order, and a common prefix is
    one more than the least one on the way from the neighbour with the same byte.
    """
    n, width = len(group), least
    steps = max((len(x) for x in lefts), default=0)
    texts = np.zeros((n, width), dtype=np.uint8)
    column = np.zeros((steps, n), dtype=np.uint8)
    for i, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        texts[i, : min(width, len(right))] = np.frombuffer(right, np.uint8)[:width]
        column[: len(left), i] = np.frombuffer(left, np.uint8)[::-1]
    reach = np.array([min(width, len(r)) for r in rights], dtype=np.int64)
    depth = np.array([len(x) for x in lefts], dtype=np.int64)
    named = np.concatenate([group.astype(">i8").view(np.uint8).reshape(n, 8), texts], axis=1)
    order = np.argsort(np.ascontiguousarray(named).view(f"V{width + 8}").ravel(), kind="stable")
    common = _prefixes(texts[order], reach[order], group[order])
    fewest, most = np.full(n, -1), np.full(n, -1)
    for step in range(steps + 1):
        again = common >= least
        again[:-1] |= again[1:]
        hit = order[again]
        most[hit] = step
        fewest[hit[fewest[hit] < 0]] = step
        if step == steps:
            break
        # Members without a byte there are done.
        going = depth[order] > step
        if not going.all():
            kept = np.flatnonzero(going)
            if not len(kept):
                break
            # A neighbour that goes leaves the least prefix on the way to the next one.
            common = np.minimum.reduceat(common[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
            common[0] = 0
            order = order[kept]
        sorting = np.lexsort((column[step, order], group[order]))
        byte, owner = column[step, order][sorting], group[order][sorting]
        same = np.concatenate([[False], (byte[1:] == byte[:-1]) & (owner[1:] == owner[:-1])])
        after = np.zeros(len(order), dtype=common.dtype)
        if same.any():
            ranges = np.empty(2 * int(same.sum()), dtype=np.int64)
            to = sorting[same]
            ranges[0::2], ranges[1::2] = sorting[np.flatnonzero(same) - 1] + 1, to + 1
            padded = np.append(common, 0)
            after[same] = np.minimum(least, 1 + np.minimum.reduceat(padded, ranges)[::2])
        order, common = order[sorting], after
    return fewest, most


def _expanded(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(row, start, stop) of what members' groups have again; groups come in a row."""
    held: list[pd.DataFrame] = []

    def done(frame: pd.DataFrame) -> pa.RecordBatch:
        group = pd.factorize(frame["key"])[0]
        fewest, most = expand(group, list(frame["before"]), list(frame["after"]), least)
        found = most >= 0
        base = frame["base"].to_numpy()
        return pa.record_batch(
            [
                pa.array(frame["row"].to_numpy()[found]),
                pa.array((base - most)[found]),
                pa.array((base - fewest + least)[found]),
            ],
            names=["row", "start", "stop"],
        )

    size = 0
    for batch in batches:
        frame = batch.to_pandas()
        held.append(frame)
        size += len(frame)
        if size >= MEMBERS:
            whole = pd.concat(held, ignore_index=True)
            # The last group may go on in the next batch.
            open_from = int((whole["key"] == whole["key"].iloc[-1]).to_numpy().argmax())
            if open_from:
                yield done(whole.iloc[:open_from].reset_index(drop=True))
            held = [whole.iloc[open_from:].reset_index(drop=True)]
            size = len(held[0])
    if held and size:
        yield done(pd.concat(held, ignore_index=True))


def _each_string(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(string, row, start): the digest of every string of each member."""
    for batch in batches:
        for row in batch.to_pylist():
            data = memoryview(row["before"] + row["after"])
            starts = np.arange(len(data) - least + 1)
            key = np.uint64(row["key"] & (2**64 - 1))
            strings = mixed(np.array([digest(data[i : i + least]) for i in starts.tolist()], np.uint64) ^ key)
            yield pa.record_batch(
                [
                    pa.array(strings.astype(np.int64)),
                    pa.array(np.full(len(starts), row["row"])),
                    pa.array(starts + row["base"] - len(row["before"])),
                ],
                names=["string", "row", "start"],
            )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _cleaned(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, text, spans in zip(
            batch.column("row").to_pylist(), raw(batch.column("text")), batch.column("spans").to_pylist(), strict=True
        ):
            gone = merged([(s["start"], s["stop"]) for s in spans])
            kept, at = [], 0
            for start, stop in gone:
                kept.append(text[at:start])
                at = stop
            left = b"".join([*kept, text[at:]])
            out.append((row, sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), left if with_text else None))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["row", "removed", "spans", "digest", "kept"],
        )


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    least: int = LEAST,
    anchor: int = ANCHOR,
    with_text: bool = True,
    members: int = MEMBERS,
) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and,
    if ``with_text``, ``kept`` (bytes).

    Removed is every byte of a string of ``least`` bytes that also starts anywhere else;
    strings are judged on the input and never cross texts.

    Runs of strings whose whole content occurs again are found by counting; only runs at
    the edges of repeated passages are expanded, with one member for each different
    content of their group. The strings of a group of more than ``members`` are counted one
    by one instead, so no group has to fit into a task. Text is shuffled once, and only
    that of rows with repeats is kept for the next steps.

    Rows are told apart by their place in the scan, so ``docs`` must give the same rows in
    the same order twice, as files do. Defined cases: null texts are empty; texts shorter
    than ``least`` lose nothing; equal rows remove each other whole; an empty table gives an
    empty result; columns of ``docs`` named like a result column are replaced.
    """
    docs = without(docs, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    numbered = shipped(docs).withColumn("_rp_row", F.monotonically_increasing_id())
    data = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    texts = numbered.select(F.col("_rp_row").alias("row"), data.alias("text"))
    entries = stored(
        texts.where(F.octet_length("text") >= least).mapInArrow(
            lambda it: _entries(it, least, anchor), "key long, content long, row long, base long, sides long"
        )
    )
    # Stored, so that both sides of the join are plain shuffles, whose hot keys Spark splits.
    repeated = stored(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    entries = stored(entries.join(repeated, "key", "left_semi"))
    classes = stored(
        entries.groupBy("key", "content").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "base", "sides")).alias("one")
        )
    )
    # Groups in which some content stands alone among others.
    contested = (
        classes.groupBy("key")
        .agg(F.count("*").alias("size"), F.min("n").alias("least"))
        .where("size > 1 and least = 1")
        .select("key", "size")
    )
    left, right = F.expr("shiftright(sides, 32)"), F.expr("sides & 4294967295L")
    wanted = classes.join(contested, "key").select(
        F.col("one.row").alias("row"),
        F.struct("key", F.col("one.base").alias("base"), F.col("one.sides").alias("sides"), "size").alias("member"),
        F.expr("cast(null as struct<start:bigint,stop:bigint>)").alias("span"),
    )
    whole = (
        entries.join(classes.where("n > 1").select("key", "content"), ["key", "content"])
        .select(
            "row",
            F.expr("cast(null as struct<key:bigint,base:bigint,sides:bigint,size:bigint>)").alias("member"),
            F.struct((F.col("base") - left).alias("start"), (F.col("base") + right).alias("stop")).alias("span"),
        )
    )
    by_row = (
        wanted.union(whole)
        .groupBy("row")
        .agg(F.collect_list("member").alias("members"), F.collect_list("span").alias("spans"))
    )
    found = stored(texts.join(by_row, "row"))
    each = (
        found.select("row", "text", F.explode("members").alias("m"))
        .select("row", "text", "m.*")
        .select(
            "key",
            "row",
            "base",
            "size",
            F.expr("substring(text, cast(base - shiftright(sides, 32) as int) + 1, cast(shiftright(sides, 32) as int))").alias("before"),
            F.expr("substring(text, cast(base as int) + 1, cast(sides & 4294967295L as int))").alias("after"),
        )
    )
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = (
        each.where(F.col("size") <= members)
        .drop("size")
        .repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda it: _expanded(it, least), "row long, start long, stop long")
    )
    strings = stored(
        each.where(F.col("size") > members)
        .drop("size")
        .mapInArrow(lambda it: _each_string(it, least), "string long, row long, start long")
    )
    again = strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    spans = spans.union(
        strings.join(again, "string").select("row", "start", (F.col("start") + least).alias("stop"))
    )
    more = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    cleaned = (
        found.select("row", "text", "spans")
        .join(more, "row", "left")
        .select("row", "text", F.concat("spans", F.coalesce("more", F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"))).alias("spans"))
        .mapInArrow(
            lambda it: _cleaned(it, with_text), "row long, removed long, spans long, digest string, kept binary"
        )
    )
    columns = [quoted(c) for c in docs.columns if with_text or c != text_col]
    plain = numbered.select(
        *columns,
        F.col("_rp_row"),
        F.octet_length(data).cast("long").alias("n_bytes"),
        F.sha2(data, 256).alias("_rp_digest"),
        *([data.alias("_rp_text")] if with_text else []),
    )
    joined = plain.join(cleaned, plain["_rp_row"] == cleaned["row"], "left")
    made = [
        plain["n_bytes"],
        F.coalesce(cleaned["removed"], F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(cleaned["spans"], F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(cleaned["digest"], plain["_rp_digest"]).alias("kept_sha256"),
    ]
    if with_text:
        made.append(F.coalesce(cleaned["kept"], plain["_rp_text"]).alias("kept"))
    kept = [c for c in docs.columns if with_text or c != text_col]
    return joined.select(*[plain["`" + c.replace("`", "``") + "`"] for c in kept], *made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return rows.withColumns({"n_kept": F.expr("n_bytes - n_removed"), "has_repeats": F.expr("n_removed > 0")})
