"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with a smallest period that repeats at least four times. Every
such run holds a block of a dyadic length, at a multiple of half that length, that is as
long as the period or up to twice as long and comes again one period later inside the
run. The occurrences of a block in the window after it form an arithmetic progression, whose
difference, the distance to the next occurrence, is a candidate period. The next occurrence
is a range successor: the smallest position after the block's own among the suffixes of the
suffix array that begin with the block, found in a wavelet tree over that array. A
candidate is extended to both sides as far as words a period apart agree.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import WORD, documents, in_batches, raw_bytes

#: Words of texts that are searched together; a longer text is searched by itself.
TOGETHER = 1 << 19
#: A run has this many words at least, and repeats this often.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: The smallest block is of 2**FIRST words: it meets every run of a period of 1 to 4 words.
FIRST = 2


class WaveletTree:
    """Range successors over an array that has each number below its length once.

    Bit by bit from the highest, numbers with a 0 come before those with a 1; ``zeros`` counts
    those with a 0 before each place.
    """

    def __init__(self, values: np.ndarray):
        self.zeros: list[np.ndarray] = []
        self.bits = range(max(1, int(len(values)).bit_length()) - 1, -1, -1)
        for bit in self.bits:
            ones = ((values >> bit) & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32))
            values = np.concatenate([values[~ones], values[ones]])

    def successor(self, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest number of at least ``least`` in each range, or -1 if there is none."""
        rank = self._below(left, right, least)
        return np.where(rank < right - left, self._ranked(left, right, rank), -1)

    def _below(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        count = np.zeros(len(left), dtype=np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b, one = zeros[left], zeros[right], (limit >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return count

    def _ranked(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of that rank in each range; anything where the range is shorter."""
        rank = np.minimum(rank, right - left - 1)
        value = np.zeros(len(left), dtype=np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value |= one.astype(np.int64) << bit
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return value


class Suffixes:
    """The suffix array of some texts by doubling, with the steps on the way.

    ``symbols`` are numbers that differ between texts, each text ended by one that
    occurs nowhere else; so nothing is equal across texts, nor beyond the end of one.
    ``ranks[k]`` has, for each place, where the suffixes that share its first 2**k symbols
    begin in the suffix array; ``shared[k]`` the places of which there are several and how many.
    """

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.ranks: list[np.ndarray] = []
        self.shared: list[tuple[np.ndarray, np.ndarray]] = []
        rank, places, counts = self._split(np.zeros(self.size, np.int32), np.arange(self.size), symbols)
        while len(places):
            self.ranks.append(rank)
            self.shared.append((places, counts))
            after = rank[places + (1 << (len(self.ranks) - 1))]
            rank, places, counts = self._split(rank, places, rank[places].astype(np.int64) * self.size + after)
        self.array = np.empty(self.size, np.int64)
        self.array[rank] = np.arange(self.size)

    def _split(self, rank: np.ndarray, places: np.ndarray, keys: np.ndarray):
        """Ranks after splitting groups of equal rank by their keys, and who still shares one."""
        if not len(places):
            return rank, places, places
        order = np.argsort(keys, kind="stable")
        places, keys, old = places[order], keys[order], rank[places[order]]
        begins = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.flatnonzero(begins)
        own = np.cumsum(begins) - 1
        olds = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        old_start = olds[np.searchsorted(olds, group, "right") - 1]
        rank = rank.copy()
        rank[places] = old + (group - old_start).astype(np.int32)[own]
        counts = np.diff(np.append(group, len(places)))[own]
        several = counts > 1
        return rank, places[several], counts[several]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from ``a`` and ``b`` on agree."""
        from_a, a, b = a, a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[k][a] == self.ranks[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - from_a

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before ``a`` and ``b`` agree, for ``a`` before ``b``."""
        from_a, a, b = a, a.copy(), b.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = 1 << k
            inside = a >= step
            same = inside & (self.ranks[k][np.where(inside, a - step, 0)] == self.ranks[k][np.where(inside, b - step, 0)])
            a[same] -= step
            b[same] -= step
        return from_a - a


def find_runs(symbols: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    none = np.empty((0, 3), np.int64)
    suffixes = Suffixes(symbols)
    if len(suffixes.ranks) <= FIRST:
        return none
    tree = WaveletTree(suffixes.array)
    found = [none]
    for k in range(FIRST, len(suffixes.ranks)):
        block = 1 << k
        places, counts = suffixes.shared[k]
        aligned = places % (block // 2) == 0
        places, counts = places[aligned], counts[aligned]
        left = suffixes.ranks[k][places].astype(np.int64)
        period = tree.successor(left, left + counts, places + 1) - places
        # Shorter periods are found by shorter blocks.
        near = (period > (0 if k == FIRST else block // 2)) & (period <= block)
        places, period = places[near], period[near]
        before = suffixes.backward(places, places + period)
        length = before + period + suffixes.forward(places, places + period)
        enough = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([places - before, length, period], axis=1)[enough])
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _searched(texts: list[bytes], min_length: int, min_exponent: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text its number of words, its runs, and its words with repetitions left out."""
    names: defaultdict[bytes, int] = defaultdict()
    names.default_factory = lambda: len(names) + 1
    words = [text.split() for text in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    for start, own in zip(starts.tolist(), words, strict=True):
        symbols[start : start + len(own)] = np.fromiter(map(names.__getitem__, own), np.int64, len(own))
    symbols += np.repeat(np.arange(len(texts)), sizes + 1) * (len(names) + 1)
    runs = find_runs(symbols, min_length, min_exponent)
    change = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change)[:-1] > 0
    bounds = np.searchsorted(runs[:, 0], np.append(starts, len(symbols)))
    for i, own in enumerate(words):
        mine = runs[bounds[i] : bounds[i + 1]]
        if len(mine):
            kept = np.flatnonzero(~dropped[starts[i] : starts[i] + len(own)]).tolist()
            own = [own[j] for j in kept]
        yield int(sizes[i]), mine - [starts[i], 0, 0], b" ".join(own)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts whose words fit ``TOGETHER``, a word being of two bytes at least, or one text."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) // 2 + 1 > TOGETHER:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text) // 2 + 1
    if group:
        yield group


def periodic_runs(
    docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """``docs`` without its text, with its periodic runs and what is left without them.

    Columns: n_words; runs, an array of (start, length, period) in words from 0, by start, then
    period; collapsed, the words that no run contains after its first period, joined by
    blanks. Words are what ASCII white space separates; equal ones have equal bytes.

    The search is whole for ``min_exponent`` of 4 or more and ``min_length`` of 6 or more; less is
    an error. Defined cases: null and empty texts have no words, no runs and an empty
    ``collapsed``; repeated rows get equal results; runs with equal starts are all there;
    columns of ``docs`` named like a result column are replaced; an empty table gives an empty
    one. A text is searched as a whole, in memory that grows with its words, times the logarithm of
    the longest repeated passage in it.
    """
    if min_exponent < MIN_EXPONENT or min_length < MIN_LENGTH:
        raise ValueError(f"runs need an exponent of {MIN_EXPONENT} and {MIN_LENGTH} words at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(column: pa.Array) -> list[pa.Array]:
        rows = [r for group in _groups(raw_bytes(column)) for r in _searched(group, min_length, min_exponent)]
        ends = np.cumsum([0, *(len(runs) for _, runs, _ in rows)]).astype(np.int32)
        flat = np.concatenate([np.empty((0, 3), np.int64), *(runs for _, runs, _ in rows)])
        entries = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
        return [
            pa.array([n for n, _, _ in rows], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), entries).cast(kind),
            pa.array([text for _, _, text in rows], pa.binary()).cast(pa.string()),
        ]

    fields = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return in_batches(docs, text_col, searched, fields)


def _repeating(doc_id: Column, text: Column) -> Column:
    """The contract's change to a tenth of the documents: from a word on, the text repeats."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def repeated(given: Column) -> Column:
        n, g = F.size(given).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(given, place(i))), " ")

    # One word list, bound once.
    planted = F.transform(F.array(words), lambda given: F.when(F.size(given) > 0, repeated(given)).otherwise(text))
    return F.when(h % 10 == 0, F.get(planted, F.lit(0))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which is first made to repeat, and their digests."""
    docs = documents(spark, sf_dir)
    rows = periodic_runs(docs.select("doc_id", _repeating(F.col("doc_id"), F.col("text")).alias("text")))
    # The greatest exponent, exactly; of equal ones the first in order.
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    best = F.reduce(
        "runs",
        F.expr("CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>)"),
        lambda best, run: F.when(better(best, run), run).otherwise(best),
    )
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
