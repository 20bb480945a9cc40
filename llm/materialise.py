"""Training-order materialisation: a keyed permutation gives every sequence its slot.

Texts become token ids, cut into sequences of a fixed number. A Feistel network with cycle-walking
permutes the sequences' numbers; range partitions of slots hold shards of fixed stride,
so a reader finds any slot by arithmetic and can go on anywhere.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import VOCABULARY, load
from llm.common import documents, quoted, scratch, shipped, stored, stored_in_turn
from llm.hashing import mixed, raw

#: Tokens per sequence, sequences per shard, bytes of a range partition at most.
SEQUENCE, SHARD, PARTITION_BYTES = 1024, 4096, 32 << 20
#: Passes over the stored ids that write shards, at most; each shuffles its share of the sequences.
PASSES = 4
#: A token's bytes: little-endian, unsigned. The largest number is padding, no token.
TOKEN = np.dtype("<u2")
#: Pieces that a task remembers while it encodes; nothing else takes its memory here.
REMEMBERED = 500_000
#: Characters encoded at once, so that a word is looked up once for all their texts.
CHUNK = 2 << 20
PAD = np.iinfo(TOKEN).max

ROUNDS = 6


def round_keys(key: str) -> np.ndarray:
    digest = hashlib.shake_256(key.encode()).digest(8 * ROUNDS)
    return np.frombuffer(digest, "<u8")


def _half_bits(size: int) -> int:
    return max(1, ((size - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (mixed(right + key) & mask)
    return (right << shift) | left


def permute(index: np.ndarray, size: int, key: str, inverse: bool = False) -> np.ndarray:
    """The slot of each index in 0..size-1, or with ``inverse`` the index of each slot.

    The network works on the next even power of two; values outside are encrypted again
    until they fall inside. Swapping both halves makes it its own inverse under reversed
    keys.
    """
    keys = round_keys(key)
    keys, half = keys[::-1] if inverse else keys, _half_bits(size)
    with np.errstate(over="ignore"):
        out = _feistel(np.asarray(index, dtype=np.uint64), half, keys)
        while (outside := out >= np.uint64(size)).any():
            out[outside] = _feistel(out[outside], half, keys)
    return out


def sequences(tokens: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sequences, one after the other, and the number of each text's.

    ``tokens`` are a text's ids with the end token; its last sequence is padded.
    """
    chunks = [np.frombuffer(t, TOKEN) for t in raw(tokens)]
    sizes = np.array([len(c) for c in chunks], dtype=np.int64)
    counts = -(-sizes // length)
    out = np.full(int(counts.sum()) * length, PAD, dtype=TOKEN)
    starts = (np.cumsum(counts) - counts) * length
    for chunk, start, size in zip(chunks, starts, sizes, strict=True):
        out[start : start + size] = chunk
    return out, counts


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path, REMEMBERED)
    if len(model.texts) > PAD or not model.specials:
        raise ValueError("the vocabulary must fit two bytes and have an end token")
    end = np.array([max(model.specials.values())], TOKEN)
    for batch in batches:
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        ids = [np.concatenate([a.astype(TOKEN), end]).tobytes() for a in model.encode(texts, CHUNK)]
        yield pa.record_batch([batch.column("_id"), pa.array(ids, pa.binary())], names=["_id", "_tokens"])


def _placed(
    batches: Iterator[pa.RecordBatch],
    first: dict[int, tuple[int, int]],
    size: int,
    length: int,
    key: str,
    start: int,
    stop: int,
) -> Iterator[pa.RecordBatch]:
    """Rows (slot, doc, part, tokens) of a partition's tokens, those of slots from ``start`` to before ``stop``."""
    at = end = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if at is None:
            at, end = first[batch.column("_pid")[0].as_py()]
        counts = -(-pc.binary_length(batch.column("_tokens")).to_numpy() // (length * TOKEN.itemsize))
        total = int(counts.sum())
        if at + total > end:
            raise RuntimeError("the input gave other rows than when it was counted")
        slots = permute(np.arange(at, at + total), size, key)
        at += total
        mine = (slots >= start) & (slots < stop)
        docs = np.repeat(np.arange(batch.num_rows), counts)
        hit = np.zeros(batch.num_rows, dtype=bool)
        hit[docs[mine]] = True
        if not hit.any():
            continue
        parts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        tokens, _ = sequences(batch.column("_tokens").filter(pa.array(hit)), length)
        held = pa.py_buffer(tokens.reshape(-1, length)[mine[hit[docs]]])
        n = int(mine.sum())
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (length * TOKEN.itemsize))
        yield pa.record_batch(
            [
                pa.array(slots[mine].astype(np.int64)),
                batch.column("_id").take(pa.array(docs[mine])),
                pa.array(parts[mine]),
                pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], held]),
            ],
            names=["slot", "doc_id", "part", "tokens"],
        )
    if at is not None and at != end:
        raise RuntimeError("the input gave other rows than when it was counted")


class Order:
    """The sequences of a table and their training order; ``rows`` gives them by slot.

    Texts are encoded once, each with the vocabulary's end token, and the ids stored. One
    pass over these counts the sequences of each partition; only the counts, one number
    per partition, reach the driver. Another pass numbers the sequences from there; a
    partition that gives other rows than when it was counted is an error, never a wrong
    order.
    """

    def __init__(
        self,
        docs: DataFrame,
        key: str,
        length: int = SEQUENCE,
        shard: int = SHARD,
        id_col: str = "doc_id",
        text_col: str = "text",
        partition_bytes: int = PARTITION_BYTES,
        path: str = VOCABULARY,
    ):
        texts = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
        self.key, self.length, self.shard = key, length, shard
        self.id_type = texts.schema["_id"].dataType.simpleString()
        self.source = stored(
            shipped(texts).mapInArrow(lambda it: _encoded(it, path), f"_id {self.id_type}, _tokens binary"),
            compression="zstd",
        ).withColumn("_pid", F.spark_partition_id())
        self.width = width = length * TOKEN.itemsize
        sized = F.expr(f"(octet_length(_tokens) + {width} - 1) div {width}")
        counted = self.source.groupBy("_pid").agg(F.sum(sized).alias("n")).orderBy("_pid").collect()
        self.first, self.size = {}, 0
        for row in counted:
            self.first[row["_pid"]] = (self.size, self.size + row["n"])
            self.size += row["n"]
        self.per_range = max(1, partition_bytes // (shard * width)) * shard

    def rows(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """The sequences of slots from ``start`` to before ``stop``, in order; other sequences aren't shuffled."""
        first, size, length, key, per_range = self.first, self.size, self.length, self.key, self.per_range
        stop = size if stop is None else min(stop, size)
        rows = self.source.mapInArrow(
            lambda it: _placed(it, first, size, length, key, start, stop),
            f"slot long, doc_id {self.id_type}, part long, tokens binary",
        )
        ranges = max(1, -(-(stop - start) // per_range))
        return (
            rows.repartitionById(ranges, F.expr(f"cast((slot - {start}) div {per_range} as int)"))
            .sortWithinPartitions("slot")
            .select(
                "slot",
                F.expr(f"slot div {self.shard}").alias("shard"),
                F.expr(f"slot % {self.shard} * {self.width}").alias("byte_offset"),
                "doc_id",
                "part",
                "tokens",
            )
        )

    def passes(self, most: int = PASSES) -> list[DataFrame]:
        """``rows`` in ``most`` stretches of whole ranges, or fewer; no range, and so no shard, is in two."""
        ranges = max(1, -(-self.size // self.per_range))
        step = -(-ranges // most) * self.per_range
        return [self.rows(start, start + step) for start in range(0, max(1, self.size), step)]


def materialise(docs: DataFrame, key: str, *args, **options) -> DataFrame:
    """All sequences in training order: slot, shard, byte_offset, doc_id, part, tokens.

    Takes what ``Order`` takes. Slots are 0 to the number of sequences less one. ``tokens``
    has ``length`` ids of two bytes; ``byte_offset`` is its place in the shard.

    Defined cases: null and empty texts are one sequence with an end token; equal rows get
    slots of their own; an empty table gives an empty result; other columns are not read.
    """
    return Order(docs, key, *args, **options).rows()


def _shard_name(folder: str, shard: int) -> str:
    return f"{folder.rstrip('/')}/shard-{shard:012d}.bin"


def _written(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    out = name = digest = None
    shard, count, done = None, 0, []
    # Another attempt of this task may be writing the same shards.
    part = f"part-{TaskContext.get().taskAttemptId()}"

    def close():
        out.close()
        files.move(f"{name}.{part}", name)
        done.append({"shard": shard, "path": name, "sequences": count, "sha256": digest.hexdigest()})

    for batch in batches:
        shards, column = batch.column("shard").to_numpy(), batch.column("tokens").cast(pa.large_binary())
        _, ends, held = column.buffers()
        ends = np.frombuffer(ends, np.int64)[column.offset :] if len(column) else [0]
        # Rows of one shard that follow each other are written at once.
        changes = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for start, stop in itertools.pairwise(changes if len(shards) else []):
            if shards[start] != shard:
                if out:
                    close()
                shard, count, digest = int(shards[start]), 0, hashlib.sha256()
                name = _shard_name(root, shard)
                out = files.open_output_stream(f"{name}.{part}")
            tokens = held.slice(int(ends[start]), int(ends[stop] - ends[start]))
            out.write(tokens)
            digest.update(tokens)
            count += stop - start
    if out:
        close()
    if done:
        yield pa.RecordBatch.from_pylist(done)


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the shards of ``materialise`` as files into a shared folder (a URI).

    Returns the manifest: shard, path, sequences, sha256. A file appears under its name
    only when whole; a repeated task writes the same bytes again, and attempts that run at
    the same time write under names of their own until then.
    """
    return shipped(ordered).select("shard", "tokens").mapInArrow(
        lambda it: _written(it, folder), "shard long, path string, sequences long, sha256 string"
    )


def _indexed(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the shards of a range; its rows without tokens, with their shards' manifest."""
    held = []

    def seen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held.append(batch.drop_columns(["tokens"]))
            yield batch

    manifests = list(_written(seen(), folder))
    if not manifests:
        return
    manifest = pa.Table.from_batches(manifests)
    for rows in held:
        own = manifest.take(pc.index_in(rows.column("shard"), manifest["shard"].combine_chunks()))
        for name in ("sequences", "sha256"):
            rows = rows.append_column(name, own[name].combine_chunks())
        yield rows


def _read_back(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``_indexed`` with the tokens that their shard holds at their offset."""
    files, root = pafs.FileSystem.from_uri(folder)
    file = shard = None
    for batch in batches:
        tokens, n = [], batch.num_rows
        shards, offsets = batch.column("shard").to_numpy(), batch.column("byte_offset").to_numpy()
        # Rows that follow each other in a shard are read at once.
        changes = np.flatnonzero((np.diff(shards) != 0) | (np.diff(offsets) != width)) + 1
        for start, stop in itertools.pairwise([0, *changes.tolist(), n] if n else []):
            if shards[start] != shard:
                if file:
                    file.close()
                shard = int(shards[start])
                file = files.open_input_file(_shard_name(root, shard))
            file.seek(int(offsets[start]))
            tokens.append(file.read((stop - start) * width))
        held = b"".join(tokens)
        if len(held) != n * width:
            raise RuntimeError("a shard is shorter than its rows")
        ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width)
        yield batch.append_column("tokens", pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(held)]))
    if file:
        file.close()


def through_shards(order: Order, folder: str, passes: int = PASSES) -> DataFrame:
    """Write all shards of an order into a shared folder (a URI) and read them back.

    The rows are those of ``materialise`` with the tokens as the files hold them, and
    ``sequences`` and ``sha256`` of their shard. A range of slots is held by its task
    without the tokens. Each pass shuffles a share of the sequences and drops its shuffle
    when its shards stand, so that not all are on disk twice beside the stored ids.

    Defined cases: those of ``materialise``, whose rows these are; no rows write no file.
    """
    stretches = order.passes(passes)
    types = {c: t for c, t in stretches[0].dtypes if c != "tokens"} | {"sequences": "bigint", "sha256": "string"}
    schema = ", ".join(f"{c} {t}" for c, t in types.items())
    index = stored_in_turn(
        shipped(rows).mapInArrow(lambda it: _indexed(it, folder), schema) for rows in stretches
    )
    width = order.width
    return index.mapInArrow(lambda it: _read_back(it, folder, width), f"{schema}, tokens binary").select(
        *stretches[0].columns, "sequences", "sha256"
    )


def read_from(folder: str, slot: int, size: int, length: int = SEQUENCE, shard: int = SHARD) -> Iterator[bytes]:
    """Sequences from a slot on, in order: where a stopped training run goes on."""
    files, root = pafs.FileSystem.from_uri(folder)
    width = length * TOKEN.itemsize
    while slot < size:
        with files.open_input_file(_shard_name(root, slot // shard)) as file:
            file.seek(slot % shard * width)
            while tokens := file.read(width):
                yield tokens
                slot += 1


KEY = "epoch-0"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Arrow takes a local folder's URI with an empty host only.
    folder = re.sub("^file:/(?!/)", "file:///", f"{scratch(spark)}/{uuid.uuid4().hex}")
    return through_shards(Order(documents(spark, sf_dir), KEY), folder)
