"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits written for letters to plain
ones, and turns everything else into blanks. The lexicon holds whole words and word
beginnings with their log-odds; a match inside an exception phrase doesn't count. The
sum of weights is normalised by the text's length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import documents, in_worker, quoted, shipped, stored, without

#: Labelled rows to learn from, at most: those with the smallest md5 of their id.
TRAINING_ROWS = 20_000
#: Lengths of word beginnings that may become terms.
STEMS = range(3, 9)
#: Least texts behind a term, least z of its log-odds, least log-odds outside exception
#: phrases and with them, least texts behind an exception phrase.
MIN_TEXTS, MIN_Z, MIN_WEIGHT, MIN_MIXED, MIN_PHRASE = 5, 3.0, 3.0, 1.0, 3

#: Multipliers of the min-hashes that find copies among the rows to learn from.
SKETCH_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

# Look-alikes by target letter: digits, signs and letters written for it, then Cyrillic and
# Greek letters of the same shape. Fixed values. 1 is written for i and for l, so all three
# are one letter; patterns are folded in the same way.
LOOK_ALIKES = {
    "a": "4@аαΑА",
    "b": "8вВΒ",
    "c": "сСϲ",
    "e": "3еЕεΕ",
    "h": "нНΗ",
    "i": "1lLіІιΙ",
    "k": "кКκΚ",
    "m": "мМΜ",
    "n": "ηΝ",
    "o": "0оОοΟ",
    "p": "рРρΡ",
    "s": "5$ѕЅ",
    "t": "7тТτΤ",
    "u": "υ",
    "v": "ν",
    "x": "хХχΧ",
    "y": "уУγΥ",
}


class _Folding(dict):
    """For ``str.translate``; fills itself as characters come up."""

    def __init__(self):
        super().__init__({ord(c): k for k, v in LOOK_ALIKES.items() for c in v})

    def __missing__(self, point: int):
        char = chr(point)
        if 0xFF01 <= point <= 0xFF5E:  # full-width forms
            char = chr(point - 0xFEE0)
            folded = self[ord(char)]
        elif point in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):  # zero-width
            folded = ""
        else:
            low = char.lower()
            folded = low if len(low) == 1 and low.isalnum() else " "
        self[point] = folded
        return folded


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded text with a blank at both ends."""
    return f" {(text or '').translate(_FOLDING)} "


def fold_phrase(phrase: str) -> str:
    """A phrase as a pattern: folded words between single blanks."""
    return f" {' '.join(fold(phrase).split())} "


@dataclass(frozen=True)
class Lexicon:
    """``terms``: folded pattern to weight. A pattern begins with a blank; one that also ends with
    a blank is a whole word or phrase, any other a word beginning. ``exceptions``: phrases
    between blanks whose matches don't count. ``threshold``: the normalised sum that scores
    one half."""

    terms: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    threshold: float = 1.0

    def key(self):
        return self.terms, self.exceptions


def _automaton(terms, exceptions):
    machine = ahocorasick.Automaton()
    for phrase in exceptions:
        machine.add_word(phrase, (phrase, None))
    for pattern, weight in terms:
        machine.add_word(pattern, (pattern, weight))
    if len(machine):
        machine.make_automaton()
    return machine


def matches(folded: str, lexicon: Lexicon) -> list[tuple[int, str, float]]:
    """(start, pattern, weight) of the matches that count: the longest at each place,
    outside exception phrases."""
    machine = in_worker(_automaton, *lexicon.key())
    if not len(machine):
        return []
    found: dict[int, tuple[str, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (pattern, weight) in machine.iter(folded):
        start = end - len(pattern) + 1
        if weight is None:
            spared.append((start, end))
        elif start not in found or len(found[start][0]) < len(pattern):
            found[start] = (pattern, weight)
    kept, at, reach = [], 0, -1
    spared.sort()
    for start in sorted(found):
        pattern, weight = found[start]
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if start + len(pattern.rstrip()) - 1 > reach:
            kept.append((start, pattern, weight))
    return kept


def strength(text: str | None, lexicon: Lexicon) -> float:
    """Sum of the matches' weights over the logarithm of the text's length in words."""
    folded = fold(text)
    found = matches(folded, lexicon)
    if not found:
        return 0.0
    return max(0.0, sum(w for *_, w in found)) / math.log2(8 + len(folded.split()))


def _counted(batches: Iterator[pd.DataFrame], terms_of) -> Iterator[pd.DataFrame]:
    """Per batch: term, number of toxic and of clean texts with it."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(toxic)].update(terms_of(text))
        names = list(counts[0].keys() | counts[1].keys())
        if names:  # an empty column of no type can't be sent back
            yield pd.DataFrame(
                {"term": names, "toxic": [counts[1][n] for n in names], "clean": [counts[0][n] for n in names]}
            )


def _word_terms(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def _phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Matched words with one neighbour, as phrases between blanks."""
    folded = " " + " ".join(fold(text).split()) + " "
    found = set()
    for start, *_ in matches(folded, lexicon):
        end = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", end + 1)
        if before >= 0:
            found.add(folded[before : end + 1])
        if after >= 0:
            found.add(folded[start : after + 1])
    return found


_COUNTS = "term string, toxic long, clean long"


def _summed(sample: DataFrame, terms_of) -> DataFrame:
    counted = shipped(sample).mapInPandas(lambda it: _counted(it, terms_of), _COUNTS)
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _specific(terms: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of a beginning and its longer forms keep what says most.

    A beginning gives way to one longer form with nearly all of its texts; what is left of
    longer forms gives way to a beginning of about their weight.
    """
    best: dict[str, int] = {}
    for term, (texts, _) in terms.items():
        stem = term.rstrip()
        for n in range(len(stem) - 1 if term == stem else len(stem), 3, -1):
            best[stem[:n]] = max(best.get(stem[:n], 0), texts)
    kept = {t: v for t, v in terms.items() if t.endswith(" ") or best.get(t, 0) < 0.95 * v[0]}
    return {
        t: weight
        for t, (_, weight) in kept.items()
        if not any(p in kept and kept[p][1] > weight - 0.7 for n in range(4, len(t)) if (p := t[:n]) != t)
    }


def _sketches(text: str) -> list[int]:
    """Three min-hashes of the text's five-word shingles."""
    words = fold(text).split()
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    hashes = np.array([zlib.crc32(s.encode()) for s in shingles], dtype=np.uint64)
    return [int(((hashes * np.uint64(a) + np.uint64(7)) & np.uint64(0xFFFFFFFF)).min()) for a in SKETCH_FACTORS]


def _sketched(texts: pd.Series) -> pd.Series:
    return pd.Series([_sketches(t) for t in texts])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """Stored sample (text, toxic): at most ``limit`` labelled rows that aren't held out,
    equal texts and most near copies once: a copied passage is no new evidence."""
    chosen = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(limit)
    )
    # At most ``limit`` rows of two numbers, hence broadcast.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id"
    )
    rows = shipped(found).withColumn("_at", F.pandas_udf(_sketched, "array<long>")("text"))
    for i in range(len(SKETCH_FACTORS)):
        rows = rows.groupBy(F.col("_at")[i]).agg(
            *[F.max_by(c, F.struct("toxic", "text")).alias(c) for c in ("text", "toxic", "_at")]
        ).select("text", "toxic", "_at")
    return stored(rows.drop("_at"))


def learn(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon with threshold from rows (text, toxic).

    Terms and phrases are chosen by their counts alone, as many as there are; as each needs
    some texts of the bounded sample, the sample bounds them too.
    """
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon()
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = min(MIN_TEXTS, 1 + toxic // 10)

    def strong(counts: DataFrame, odds: float) -> dict[str, tuple[int, float]]:
        chosen = (
            counts.where(F.col("toxic") >= least)
            .withColumns({"weight": weight, "z": weight / spread})
            .where((F.col("weight") >= odds) & (F.col("z") >= min(MIN_Z, 0.5 * least)))
        )
        return {r["term"]: (r["toxic"], r["weight"]) for r in chosen.collect()}

    # Words that also stand in harmless phrases look mixed until these are known.
    mixed = Lexicon(tuple(sorted(_specific(strong(_summed(sample, _word_terms), MIN_MIXED)).items())))
    harmless = (
        _summed(sample, lambda text: _phrases(text, mixed))
        .where((F.col("toxic") == 0) & (F.col("clean") >= MIN_PHRASE))
    )
    phrases = {*map(fold_phrase, exceptions), *(r["term"] for r in harmless.collect())}
    spared = Lexicon(mixed.terms, tuple(sorted(phrases)))
    outside = _summed(sample, lambda text: {p for _, p, _ in matches(fold(text), spared)})
    terms = tuple(sorted((t, w) for t, (_, w) in strong(outside, MIN_WEIGHT).items()))
    found = tuple(p for p in spared.exceptions if any(t in p for t, _ in terms))
    lexicon = Lexicon(terms, found)
    # One pair of numbers per sampled row.
    pairs = sample.select("toxic", _strength(lexicon)("text").alias("x")).collect()
    return Lexicon(lexicon.terms, found, _cut([(r["x"], r["toxic"]) for r in pairs]))


def _cut(pairs: list[tuple[float, int]]) -> float:
    """The threshold with the best mean of both classes' accuracy, midway between values."""
    toxic = sum(y for _, y in pairs) or 1
    clean = len(pairs) - toxic or 1
    pairs = sorted(pairs)
    best, at, below = -1.0, 1.0, [0, 0]
    values = sorted({x for x, _ in pairs})
    i = 0
    for low, high in zip(values, [*values[1:], values[-1] * 2 + 1] if values else [], strict=False):
        while i < len(pairs) and pairs[i][0] <= low:
            below[pairs[i][1]] += 1
            i += 1
        good = (toxic - below[1]) / toxic + below[0] / clean
        if good > best:
            best, at = good, (low + high) / 2
    return max(at, 1e-6)


def _strength(lexicon: Lexicon):
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([strength(t, lexicon) for t in texts], dtype="float64")

    return F.pandas_udf(measure, T.DoubleType())


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Defined cases: null and empty texts score 0; equal texts score alike; without terms
    all score 0; columns of ``docs`` named like a result column are replaced.
    """
    docs = without(docs, ["score", "predicted"])
    measured = shipped(docs).withColumn("_tx", _strength(lexicon)(quoted(text_col)))
    score = F.col("_tx") / (F.col("_tx") + lexicon.threshold)
    return measured.select(
        *[quoted(c) for c in docs.columns],
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def learned(spark: SparkSession, sf_dir: str) -> Lexicon:
    """The lexicon that the labelled rows of a folder teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return learn(training_rows(documents(spark, sf_dir), labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score_toxicity(docs.withColumn("held_out", held), learned(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted")
