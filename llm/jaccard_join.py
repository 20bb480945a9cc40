"""N-gram Jaccard join with PartEnum signatures.

Sets of word shingles of about equal size that are similar enough differ in few elements.
If the domain of shingles is dealt into more parts than that, some parts are alike in
both; a signature is what a set holds in a chosen subset of parts, so similar sets share
one. Sets that share a signature are candidates. Large groups of candidates are sifted by
short marks of their sets first, which never part similar ones; what is left is compared exactly.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, in_worker, quoted, shipped, stored, stored_in_turn, without
from llm.components import connected
from llm.hashing import Digests, mixed, raw

#: Words per shingle; sets are linked from this many per cent of their union on.
SHINGLE, PER_CENT = 5, 80
#: Bytes of text that are worked on at once; signatures per bucket, about; members of a
#: block in which candidates are compared, half of them from each of two deals.
CHUNK, BUCKET, BLOCK = 1 << 20, 4_000_000, 1024
#: Shingles of a block's members, about; signatures, and classes, that a task gathers before it
#: deals them out to the buckets. A place among the classes has 16 bits.
BLOCK_SHINGLES, DEALT, DEALT_CLASSES = 8_000_000, 1_000_000, 60_000
#: So many times more members and shingles make a block in which only marks are compared.
MARKED, MARKED_SHINGLES = 4, 32
#: Bytes that a pass over the blocks shuffles, about: so many for each shingle of the input's sets, but
#: so many in all at least. The bytes of a shingle in a set, and in a mark at most.
ROOM, ROOM_LEAST, SET_BYTES, MARK_BYTES = 4, 64_000_000, 8, 0.25
#: Sets up to this size choose two of three parts, larger ones a single part of so many
#: parts per element.
PAIRED, PARTS = 64, 0.3
#: A shingle in this share of sets is frequent. Tasks count so many shingles at a time and
#: report those of half that share, and in so many sets at least.
FREQUENT, COUNTED, FREQUENT_LEAST = 0.0005, 2_000_000, 3

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25],
    dtype=np.uint64,
)


def _salted(values: np.ndarray, salt: int) -> np.ndarray:
    return mixed(values ^ np.uint64((salt * 0xA0761D6478BD642F) & (2**64 - 1)))


def shingle_sets(texts: list[memoryview], length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles, by text and hash.

    Words are runs of bytes that are no white space, A to Z lower-cased, and count by a
    cryptographic digest. A text of fewer words is one shingle; a text without words has none.
    """
    words, counts = [], []
    for text in texts:
        own = bytes(text).lower().split()
        words += own
        counts.append(len(own))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    counts = np.array(counts, dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    words = np.fromiter(map(in_worker(Digests).__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        factors = [_FACTORS[i % 5] ^ np.uint64(i) for i in range(length)]
        n = max(0, len(words) - length + 1)
        total = sum((words[i : i + n] * factors[i] for i in range(length)), np.zeros(n, np.uint64))
        inside = text[:n] == text[len(text) - n :] if n else np.zeros(0, dtype=bool)
        owner, found = text[:n][inside], mixed(total[inside])
        # Texts of fewer words.
        first = np.cumsum(counts) - counts
        few = np.flatnonzero((counts > 0) & (counts < length))
        if len(few):
            whole = np.zeros(len(few), np.uint64)
            for i in range(length - 1):
                has = counts[few] > i
                whole[has] += words[first[few[has]] + i] * factors[i]
            owner = np.concatenate([owner, few])
            found = np.concatenate([found, _salted(whole + counts[few].astype(np.uint64), 11)])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else values[:0]


@functools.lru_cache(maxsize=4)
def bands(per_cent: int) -> np.ndarray:
    """The largest size of each band: a band's largest set can be similar to its smallest,
    and sets of different bands only if the bands are neighbours."""
    tops = [0]
    while tops[-1] < 1 << 40:
        tops.append((tops[-1] + 1) * 100 // per_cent)
    return np.array(tops[1:], dtype=np.int64)


def signatures(
    owner: np.ndarray, found: np.ndarray, texts: int, frequent: np.ndarray, per_cent: int = PER_CENT
) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) of sets; similar sets share at least one signature.

    A set signs for its own band and the next. Sets of n and m elements that are similar
    differ in at most (n + m) * (100 - p) / (100 + p) elements. Leaving out frequent
    shingles leaves no more differences, so the parts deal out only the others; part by
    part, a set must fill more parts than differences can touch, or, with two of three
    parts, more triples than pairs of differences can. Two sets that both fall short have
    signatures of a second kind in common: single elements of their prefix, infrequent
    ones first.

    Of parts that count alone a set signs the fullest, one more than differences can touch: of
    two similar sets, the one that stops at the fuller part has an untouched one before it,
    and the other, with the same part, goes on further. Parts of a single element, which
    unrelated texts share by chance, so hardly ever sign.
    """
    sizes = np.bincount(owner, minlength=texts)
    tops = bands(per_cent)
    hot = np.isin(found, frequent)
    owners, signs = [], []
    band = np.searchsorted(tops, sizes)
    with np.errstate(over="ignore"):
        weight = _salted(found, 1)
        for step in (0, 1):
            top = tops[band + step]
            tag = _salted((band + step).astype(np.uint64), 2)
            largest = np.minimum(top, sizes * 100 // per_cent)
            differ = (sizes + largest) * (100 - per_cent) // (100 + per_cent)
            most = 2 * top * (100 - per_cent) // (100 + per_cent)
            paired = top <= PAIRED
            triples = most // 2 + 2
            parts = np.where(paired, 3 * triples, np.maximum(most + 2, np.ceil(PARTS * top).astype(np.int64)))
            cool = ~hot
            mine, part = owner[cool], (_salted(found[cool], 3) >> np.uint64(16)).astype(np.int64)
            part %= parts[mine]
            order = np.lexsort((part, mine))
            mine, part, load = mine[order], part[order], weight[cool][order]
            new = np.ones(len(mine), dtype=bool)
            new[1:] = (mine[1:] != mine[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(new)
            held = np.diff(np.append(first, len(mine)))
            mine, part, load = mine[first], part[first], _sums(load, first)
            # One part alone.
            one = ~paired[mine]
            who, held = mine[one], held[one]
            sign = mixed(load[one] + tag[who] + _salted(part[one].astype(np.uint64), 4))
            filled = np.bincount(who, minlength=texts)
            order = np.lexsort((sign, -held, who))
            fullest = np.arange(len(who)) - (np.cumsum(filled) - filled)[who] <= differ[who]
            owners.append(who[fullest])
            signs.append(sign[order][fullest])
            # Two of the three parts of a triple.
            mine, part, load = mine[~one], part[~one], load[~one]
            triple = part // 3
            new = np.ones(len(mine), dtype=bool)
            new[1:] = (mine[1:] != mine[:-1]) | (triple[1:] != triple[:-1])
            at = np.cumsum(new) - 1
            table = np.zeros((int(new.sum()), 3), np.uint64)
            there = np.zeros(table.shape, dtype=bool)
            table[at, part % 3], there[at, part % 3] = load, True
            who, which = mine[new], triple[new].astype(np.uint64)
            for a, b in ((0, 1), (0, 2), (1, 2)):
                some = there[:, a] | there[:, b]
                owners.append(who[some])
                signs.append(
                    mixed((table[:, a] + table[:, b] + tag[who] + _salted(which * np.uint64(4) + np.uint64(a + b), 5))[some])
                )
            whole = np.bincount(who[there.sum(axis=1) >= 2], minlength=texts)
            short = (sizes > 0) & np.where(paired, whole <= differ // 2, filled <= differ)
            # The prefix of sets that fall short.
            has = short[owner]
            mine, values, later = owner[has], found[has], hot[has]
            order = np.lexsort((values, later, mine))
            mine, values = mine[order], values[order]
            counts = np.bincount(mine, minlength=texts)
            rank = np.arange(len(mine)) - (np.cumsum(counts) - counts)[mine]
            inside = rank < (sizes - -(-sizes * per_cent // 100) + 1)[mine]
            owners.append(mine[inside])
            signs.append(mixed(_salted(values[inside], 6) + tag[mine[inside]]))
    return np.concatenate(owners), np.concatenate(signs)


def _lots(texts: list[memoryview]) -> Iterator[tuple[int, list[memoryview]]]:
    first, held, lot = 0, 0, []
    for i, text in enumerate(texts):
        lot.append(text)
        held += len(text)
        if held >= CHUNK:
            yield first, lot
            first, held, lot = i + 1, 0, []
    if lot:
        yield first, lot


def _class(owner: np.ndarray, found: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of sets and two hashes that equal sets share."""
    sizes = np.bincount(owner, minlength=texts)
    out = np.zeros((2, texts), np.uint64)
    present = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[present]
    with np.errstate(over="ignore"):
        for i in range(2):
            out[i, present] = mixed(_sums(_salted(found, 7 + i), first) + sizes[present].astype(np.uint64))
    return sizes, out[0].view(np.int64), out[1].view(np.int64)


def _frequent(shingles: list[np.ndarray], sets: int) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(shingles), return_counts=True)
    often = counts >= max(FREQUENT_LEAST, FREQUENT / 2 * sets)
    values, counts = values[often].view(np.int64), counts[often]
    zeros = pa.array(np.zeros(len(values), np.int64))
    return pa.record_batch(
        [pa.array(np.ones(len(values), dtype=bool)), zeros, pa.array(counts), pa.array(values), zeros],
        names=["frequent", "row", "n", "c1", "c2"],
    )


def _described(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(frequent, row, n, c1, c2): each text's size and class, and from time to time the
    shingles frequent so far (as c1) with their counts (as n). Equal sets count once."""
    shingles, held, seen = [], 0, set()
    for batch in batches:
        texts, rows = raw(batch.column("text")), batch.column("row").to_numpy()
        for first, lot in _lots(texts):
            owner, found = shingle_sets(lot, length)
            columns = [rows[first : first + len(lot)], *_class(owner, found, len(lot))]
            yield pa.record_batch(
                [
                    pa.array(np.zeros(len(lot), dtype=bool)),
                    *[pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in columns],
                ],
                names=["frequent", "row", "n", "c1", "c2"],
            )
            fresh = np.zeros(len(lot), dtype=bool)
            for i, value in enumerate(columns[2].tolist()):
                if value not in seen:
                    seen.add(value)
                    fresh[i] = True
            shingles.append(found[fresh[owner]])
            held += len(shingles[-1])
            if held >= COUNTED:
                yield _frequent(shingles, len(seen))
                shingles, held, seen = [], 0, set()
    if shingles:
        yield _frequent(shingles, len(seen))


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """(bucket, classes, signs) of some classes and their signatures: per bucket the classes that
    sign in it, and 48 bits of each signature with the place of its class in 16 more."""
    classes, signs = (np.concatenate(part) for part in zip(*held, strict=True))
    bucket = (signs % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((classes, bucket))
    classes, signs, bucket = classes[order], signs[order], bucket[order]
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    new = first | np.concatenate([[True], classes[1:] != classes[:-1]])
    number = np.cumsum(new) - 1
    starts = np.flatnonzero(first)
    place = number - np.repeat(number[starts], np.diff(np.append(starts, len(signs))))
    packed = (signs // np.uint64(buckets) << np.uint64(16)) | place.astype(np.uint64)
    blobs = [p.tobytes() for p in np.split(packed.astype("<u8"), starts[1:])]
    own = [p.tobytes() for p in np.split(classes[new].astype("<i8"), number[starts[1:]])]
    return pa.record_batch(
        [pa.array(bucket[starts].astype(np.int32)), pa.array(own, pa.binary()), pa.array(blobs, pa.binary())],
        names=["bucket", "classes", "signs"],
    )


def _signed(
    batches: Iterator[pa.RecordBatch], length: int, per_cent: int, frequent: np.ndarray, buckets: int
) -> Iterator[pa.RecordBatch]:
    """The texts' signatures, as ``_dealt`` packs them, some million at a time."""
    held, signs_held, classes_held = [], 0, 0
    for batch in batches:
        for _, lot in _lots(raw(batch.column("text"))):
            for at in range(0, len(lot), DEALT_CLASSES // 2):
                part = lot[at : at + DEALT_CLASSES // 2]
                owner, found = shingle_sets(part, length)
                _, c1, _ = _class(owner, found, len(part))
                values, one = np.unique(c1, return_index=True)
                # Equal sets of a lot sign once.
                first = np.zeros(len(part), dtype=bool)
                first[one] = True
                keep = first[owner]
                owner, signs = signatures(owner[keep], found[keep], len(part), frequent, per_cent)
                if not len(owner):
                    continue
                if held and (signs_held + len(signs) > DEALT or classes_held + len(values) > DEALT_CLASSES):
                    yield _dealt(held, buckets)
                    held, signs_held, classes_held = [], 0, 0
                held.append((c1[owner], signs))
                signs_held += len(signs)
                classes_held += len(values)
    if held:
        yield _dealt(held, buckets)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a bucket: each class with the smallest that shares a signature."""
    signs, classes = [], []
    for batch in batches:
        for own, blob in zip(raw(batch.column("classes")), raw(batch.column("signs")), strict=True):
            packed = np.frombuffer(blob, "<u8")
            signs.append(packed >> np.uint64(16))
            classes.append(np.frombuffer(own, "<i8")[(packed & np.uint64(0xFFFF)).astype(np.int64)])
    if not signs:
        return
    signs, classes = np.concatenate(signs), np.concatenate(classes)
    order = np.lexsort((classes, signs))
    signs, classes = signs[order], classes[order]
    new = np.ones(len(signs), dtype=bool)
    new[1:] = signs[1:] != signs[:-1]
    hub = classes[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs = np.stack([hub, classes], axis=1)[hub != classes]
    if len(pairs):
        pairs = np.unique(pairs, axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def set_bytes(owner: np.ndarray, found: np.ndarray, texts: int) -> list[bytes]:
    """Sets as bytes, a text's in its place."""
    cuts = np.cumsum(np.bincount(owner, minlength=texts))[:-1]
    return [p.astype("<u8").tobytes() for p in np.split(found, cuts)]


def mark_bytes(owner: np.ndarray, found: np.ndarray, texts: int) -> list[bytes]:
    """Marks of sets, a text's in its place: of so many bits as the set has shingles, rounded up to a
    power of two from 64 on, those that an odd number of shingles fall on.

    Marks of two sets differ in no more bits than the sets differ in shingles.
    """
    sizes = np.bincount(owner, minlength=texts)
    bits = 64 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64)
    ends = np.cumsum(bits)
    place = (found & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount((ends - bits)[owner] + place, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [p.tobytes() for p in np.split(packed, ends[:-1] // 8)]


def _packed(batches: Iterator[pa.RecordBatch], length: int, pack: Callable) -> Iterator[pa.RecordBatch]:
    """The rows with their texts' sets as ``items``, as ``pack`` makes them."""
    for batch in batches:
        for first, lot in _lots(raw(batch.column("text"))):
            items = pack(*shingle_sets(lot, length), len(lot))
            part = batch.slice(first, len(lot)).drop_columns(["text"])
            yield part.append_column("items", pa.array(items, pa.binary()))


def similar_sets(sets: list[np.ndarray], per_cent: int = PER_CENT) -> np.ndarray:
    """Which pairs of sets are linked, as a matrix: all pairs are compared, in numbers."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = counts[column] > 1
    names, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((n, n), dtype=np.float32)
    # Columns in slices, so that the matrix stays small; whole numbers are exact here.
    width = max(1, (1 << 22) // max(1, n))
    for at in range(0, len(names), width):
        inside = (column >= at) & (column < at + width)
        table = np.zeros((n, min(width, len(names) - at)), dtype=np.float32)
        table[owner[inside], column[inside] - at] = 1
        common += table @ table.T
    inter = common.astype(np.int64)
    similar = 100 * inter >= per_cent * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(similar, False)
    return similar


def maybe_similar(marks: list[np.ndarray], sizes: np.ndarray, per_cent: int = PER_CENT) -> np.ndarray:
    """Which pairs of sets may be linked by their marks and sizes, as a matrix; all that are linked may."""
    n = len(marks)
    widths = np.array([len(m) for m in marks], dtype=np.int64)
    may = np.zeros((n, n), dtype=bool)
    for width in np.unique(widths):
        wide = np.flatnonzero(widths >= width)
        # A mark of half the bits has each bit's sum with the one half the bits on.
        table = np.stack([np.bitwise_xor.reduce(marks[i].reshape(-1, width), axis=0) for i in wide])
        for i in np.flatnonzero(widths == width):
            both = sizes[wide] + sizes[i]
            near = 100 * np.minimum(sizes[wide], sizes[i]) >= per_cent * np.maximum(sizes[wide], sizes[i])
            own = np.bitwise_xor.reduce(marks[i].reshape(-1, width), axis=0)
            apart = np.bitwise_count(table[near] ^ own).sum(axis=1, dtype=np.int64)
            may[i, wide[near]] = apart <= both[near] * (100 - per_cent) // (100 + per_cent)
    may |= may.T
    np.fill_diagonal(may, False)
    return may


def forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what all links hold together."""
    left, out = np.ones(len(similar), dtype=bool), []
    for start in range(len(similar)):
        if not left[start]:
            continue
        left[start], reached = False, [start]
        for i in reached:
            fresh = np.flatnonzero(similar[i] & left)
            left[fresh] = False
            reached += fresh.tolist()
            out += [(i, j) for j in fresh.tolist()]
    return out


def _in_turn(batches: Iterator[pa.RecordBatch], links_of: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b, links), as ``links_of`` gives them for the rows of each block, which come one after the other."""
    held: list[dict] = []
    out: list[tuple[int, int | None, int]] = []

    def batch_of(found):
        a, b, links = zip(*found, strict=True)
        return pa.record_batch(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"]
        )

    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["block"] != row["block"]:
                out += links_of(held)
                held = []
            held.append(row)
        if out:
            yield batch_of(out)
            out = []
    if held:
        out += links_of(held)
    if out:
        yield batch_of(out)


def _compared(held: list[dict], per_cent: int) -> list[tuple[int, int | None, int]]:
    """Of a block of candidates links (a, b) of a spanning forest, and, with b null, how many rows a's
    set is linked with in the block.

    Members of one deal meet in several blocks; links among them count where it is at home.
    """
    rows = [r["row"] for r in held]
    similar = similar_sets([np.frombuffer(r["items"], "<u8") for r in held], per_cent)
    out = [(rows[i], rows[j], 0) for i, j in forest(similar)]
    deal, home = np.array([r["deal"] for r in held]), np.array([r["home"] for r in held])
    counted = similar & ((deal[:, None] != deal[None, :]) | home[:, None])
    links = counted @ np.array([r["copies"] for r in held], dtype=np.int64)
    return out + [(rows[i], None, int(links[i])) for i in np.flatnonzero(links)]


def _sifted(held: list[dict], per_cent: int) -> list[tuple[int, int | None, int]]:
    """Of a block's marks links (a, b) that hold together what may be similar."""
    marks = [np.frombuffer(r["items"], "<u8") for r in held]
    may = maybe_similar(marks, np.array([r["n"] for r in held], dtype=np.int64), per_cent)
    return [(held[i]["row"], held[j]["row"], 0) for i, j in forest(may)]


def _size(rows: Column, items: Column, more: int = 1, more_shingles: int = 1) -> Column:
    """How many blocks so many members and shingles are."""
    return F.greatest(rows / (BLOCK * more), items / (BLOCK_SHINGLES * more_shingles))


def _blocks(members: DataFrame, more: int, more_shingles: int) -> DataFrame:
    """(row, copies, n, blocks): names of the blocks that a member of a cluster takes part in, so
    that every two members that may be similar meet in one.

    A cluster of at most ``more`` BLOCK members and ``more_shingles`` BLOCK_SHINGLES shingles is one
    block. In larger ones the members of a band are dealt out, half a block each; two deals of one band
    or of neighbouring bands are a block, and a deal without any other to meet is one by itself.
    """
    blocks = lambda rows, items: _size(rows, items, more, more_shingles)
    sizes = members.groupBy("cluster").agg(blocks(F.count("*"), F.sum("n")).alias("all"))
    deals = stored(
        members.groupBy("cluster", "band")
        .agg(blocks(F.count("*"), F.sum("n")).alias("own"))
        .join(sizes, "cluster")
        .where(F.col("all") > 1)
        .select("cluster", "band", F.ceil(F.col("own") * 2).cast("int").alias("deals"))
    )
    above = deals.select("cluster", (F.col("band") - 1).alias("band"), F.col("deals").alias("above"))
    below = deals.select("cluster", (F.col("band") + 1).alias("band"), F.col("deals").alias("below"))
    told = deals.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    told = told.na.fill(0, ["above", "below"])
    dealt = members.join(told, ["cluster", "band"], "left").withColumn(
        "deal", F.pmod(F.xxhash64("row"), F.col("deals")).cast("int")
    )
    own, band = F.col("deal"), F.col("band")

    def name(low: Column, i: Column, high: Column, j: Column) -> Column:
        parts = ["cluster", *[c.cast("string") for c in (low, i, high, j)]]
        return F.concat_ws(":", *parts)

    def each(n: Column, block) -> Column:
        none = F.expr("cast(array() as array<string>)")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), block)).otherwise(none)

    alone = (F.col("deals") == 1) & (F.col("above") == 0) & (F.col("below") == 0)
    within = F.filter(
        each(F.col("deals"), lambda j: F.when((j != own) | alone, name(band, F.least(own, j), band, F.greatest(own, j)))),
        lambda b: b.isNotNull(),
    )
    many = F.concat(
        within,
        each(F.col("above"), lambda j: name(band, own, band + 1, j)),
        each(F.col("below"), lambda j: name(band - 1, j, band, own)),
    )
    whole = F.array(F.col("cluster").cast("string"))
    return dealt.select("row", "copies", "n", F.when(F.col("deals").isNull(), whole).otherwise(many).alias("blocks"))


def _met(
    texts: DataFrame, blocks: DataFrame, length: int, pack: Callable, links_of: Callable, bytes_each: float, room: int
) -> DataFrame:
    """(a, b, links) of all blocks, as ``links_of`` gives them.

    A member goes to each of its blocks. Blocks are met in as many passes as keep the bytes of
    a pass within ``room``, and each pass drops its shuffle, so disk doesn't grow with the blocks.
    """
    blocks = stored(blocks)
    sent = blocks.agg(F.coalesce(F.sum(F.col("n") * F.size("blocks")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(sent * bytes_each / room))
    columns = "row long, copies long, n long, deal long, first string, blocks array<string>"

    def one(turn: int) -> DataFrame:
        mine = F.filter("blocks", lambda b: F.pmod(F.xxhash64(b), F.lit(passes)) == turn)
        deal, first = F.xxhash64("blocks").alias("deal"), F.get("blocks", F.lit(0)).alias("first")
        own = blocks.select("row", "copies", "n", deal, first, mine.alias("blocks")).where(F.size("blocks") > 0)
        return (
            # Like that at every size, as the larger inputs need it.
            texts.join(own.hint("merge"), "row")
            .select(*own.columns, "text")
            .mapInArrow(lambda it: _packed(it, length, pack), f"{columns}, items binary")
            .withColumn("block", F.explode("blocks"))
            .select("block", "row", "copies", "n", "items", "deal", (F.col("block") == F.col("first")).alias("home"))
            .repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
            .sortWithinPartitions("block")
            .mapInArrow(lambda it: _in_turn(it, links_of), "a long, b long, links long")
        )

    return stored_in_turn(one(turn) for turn in range(passes))


def _sift(texts: DataFrame, members: DataFrame, length: int, per_cent: int, room: int) -> DataFrame:
    """``members``, those of clusters beyond a block in smaller clusters, which their marks hold
    together, or gone, if their marks rule out all others."""
    large = members.groupBy("cluster").agg(_size(F.count("*"), F.sum("n")).alias("all")).where(F.col("all") > 1)
    large = stored(large.select("cluster"))
    if large.isEmpty():
        return members
    beyond = stored(members.join(large, "cluster").select(*members.columns))
    blocks = _blocks(beyond, MARKED, MARKED_SHINGLES)
    links = _met(texts, blocks, length, mark_bytes, lambda held: _sifted(held, per_cent), MARK_BYTES, room)
    found = connected(links.select("a", "b"))
    kept = beyond.drop("cluster").join(found, F.col("row") == F.col("vertex"))
    kept = kept.withColumn("cluster", F.col("component")).select(*members.columns)
    return stored(members.join(large, "cluster", "left_anti").select(*members.columns).union(kept))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SHINGLE,
    per_cent: int = PER_CENT,
) -> DataFrame:
    """Every row of ``docs`` with ``n_shingles``, ``component_id``, ``n_links`` and ``first``.

    Two rows are linked if their sets of ``length``-word shingles have ``per_cent`` of their
    union in common. ``component_id`` is the smallest id that links reach; ``n_links`` counts
    the other rows that a row is linked with; ``first`` is true for one row of each component,
    one with that id.

    Equal sets are one class throughout. Signatures go through buckets that hold a bounded
    number each; a class of one lot signs once. What shares a signature, directly or in
    turn, is a cluster. One beyond a block is sifted by marks of its sets, some fiftieth of their
    size, into clusters of what these don't rule out. Every two sets of a cluster of possibly
    similar sizes are compared in blocks of bounded size, in passes that shuffle a bounded
    share of the input and drop it. Numbers of links and the links of a spanning forest leave a block.
    Frequent shingles, a number bounded by the sets' mean size over ``FREQUENT``, go to the
    tasks as a list; they only save work.

    Rows are told apart by their place in the scan, so ``docs`` must give the same rows in
    the same order each time, as files do. Defined cases: null and empty texts, and those of
    white space, have empty sets and are linked with nothing, so they keep their own id;
    texts of fewer words are one shingle; a null id is smaller than any other when ``first``
    is chosen and ignored for ``component_id`` unless all are null; equal rows are linked;
    an empty table gives an empty result; columns of ``docs`` named like a result column
    are replaced.
    """
    docs = without(docs, ["n_shingles", "component_id", "n_links", "first"])
    spark = docs.sparkSession
    numbered = shipped(docs).withColumn("_jj_row", F.monotonically_increasing_id())
    texts = numbered.select(
        F.col("_jj_row").alias("row"), F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")).alias("text")
    )
    told = stored(texts.mapInArrow(lambda it: _described(it, length), "frequent boolean, row long, n long, c1 long, c2 long"))
    sets = told.where("not frequent and n > 0").select("row", "n", "c1", "c2")
    classes = stored(
        sets.groupBy("c1", "c2").agg(F.min("row").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"))
    )
    n_classes, shingles = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    often = told.where("frequent").groupBy("c1").agg(F.sum("n").alias("n"))
    often = often.where(F.col("n") >= max(FREQUENT_LEAST, FREQUENT * n_classes)).select("c1")
    frequent = np.sort(np.array([r["c1"] for r in often.collect()], dtype=np.int64).view(np.uint64))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // BUCKET))
    signed = texts.select("text").mapInArrow(
        lambda it: _signed(it, length, per_cent, frequent, buckets), "bucket int, classes binary, signs binary"
    )
    candidates = signed.repartitionById(buckets, F.col("bucket")).mapInArrow(_joined, "a long, b long")
    clusters = connected(candidates)
    tops = bands(per_cent)
    band = F.size(F.filter(F.array(*[F.lit(int(t)) for t in tops]), lambda t: t < F.col("n")))
    members = stored(
        classes.join(clusters, F.col("c1") == F.col("vertex")).select(
            F.col("rep").alias("row"), F.col("component").alias("cluster"), band.alias("band"), "n", "copies"
        )
    )
    room = max(ROOM * shingles, ROOM_LEAST)
    blocks = _blocks(_sift(texts, members, length, per_cent, room), 1, 1)
    compared = _met(texts, blocks, length, set_bytes, lambda held: _compared(held, per_cent), SET_BYTES, room)
    found = connected(compared.where("b IS NOT NULL").select("a", "b"))
    degrees = compared.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    labelled = (
        classes.join(found, F.col("rep") == F.col("vertex"), "left")
        .join(degrees, F.col("rep") == F.col("a"), "left")
        .select(
            "c1",
            "c2",
            F.coalesce("component", "rep").alias("label"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        )
    )
    rows = numbered.select(F.col("_jj_row").alias("row"), quoted(id_col).alias("id"))
    placed = stored(
        rows.join(told.where("not frequent").select("row", "n", "c1", "c2"), "row")
        .join(labelled, ["c1", "c2"], "left")
        # A row without a set is its own component; labels are rows, so these are free.
        .select("row", "id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "row").alias("label"))
    )
    # Stored, so that Spark can split a large component in the join.
    heads = stored(
        placed.groupBy("label").agg(
            F.min("id").alias("head_id"), F.min(F.struct("id", "row")).alias("head")
        )
    )
    decided = placed.join(heads, "label").select(
        F.col("row").alias("_jj_at"),
        F.col("n").alias("n_shingles"),
        F.col("head_id").alias("component_id"),
        F.col("links").cast("long").alias("n_links"),
        (F.col("row") == F.col("head.row")).alias("first"),
    )
    return numbered.join(decided, F.col("_jj_row") == F.col("_jj_at")).select(
        *[quoted(c) for c in docs.columns], "n_shingles", "component_id", "n_links", "first"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    return jaccard_components(docs, id_col, text_col).where(F.col("first")).select(*[quoted(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id", "n_links")
