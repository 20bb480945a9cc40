"""Quality rules from tokeniser fertility.

How well the vocabularies of public tokenizers fit a text tells whether it is like other
texts of its language: characters per token and the entropy of its tokens in one vocabulary, the
share of bytes whose characters another one has no piece for. What most texts of a language
and size measure gives bands; a text beyond them is rejected, as is one that fails plain rules.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, in_batches, quoted, stored, without

#: The vocabularies' files; executors read them at the same places.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Plain rules: words at least; percent of words in windows that occur again; words a window.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: A band ends so many times as far from the median as the quartile on that side, and by the
#: measure's own least distance at least.
WIDTH = 5.0
LEAST = {"chars_per_token": 0.1, "entropy": 0.1, "fallback_share": 0.02}
#: Texts that a band of a language or script and size must be drawn from.
MIN_TEXTS = 50
#: Longest stretch without, or of, white space that is encoded as one.
STRETCH = 1_000

_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\r\v\f"
_LONG = re.compile(rf"\S{{{STRETCH}}}|\s{{{STRETCH}}}")
# First code points of blocks, and the script that most letters from there on belong to. Fixed values.
_SCRIPTS = {
    0x0000: "latin", 0x0370: "greek", 0x0400: "cyrillic", 0x0530: "armenian", 0x0590: "hebrew",
    0x0600: "arabic", 0x0900: "indic", 0x0E00: "thai", 0x0E80: "other", 0x10A0: "georgian",
    0x1100: "hangul", 0x1200: "other", 0x1E00: "latin", 0x1F00: "greek", 0x2000: "other",
    0x3040: "kana", 0x3100: "other", 0x3400: "han", 0xA000: "other", 0xAC00: "hangul",
    0xD800: "other", 0x20000: "han", 0x32000: "other",
}

_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, entropy double, fallback_share double, script string"
)


@functools.lru_cache(maxsize=1)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _in_pieces(path: str) -> np.ndarray:
    """For every code point, whether the vocabulary has it as a piece; white space is one."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = np.zeros(0x110000, dtype=bool)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if len(piece) == 1:
            table[ord(piece)] = True
    table[[ord(c) for c in _BLANKS]] = True
    return table


@functools.cache
def _scripts() -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(_SCRIPTS)), np.array(list(_SCRIPTS.values()))


def _parts(text: str) -> list[str]:
    """The text, cut inside stretches that would cost the square of their length."""
    if len(text) < STRETCH or not _LONG.search(text):
        return [text]
    cuts = [0, *(m.end() for m in _LONG.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more. Equal windows get equal
    numbers, pair by pair, so nothing rests on hashes."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    numbers, rest, at, size = None, window, 0, 1
    power = ids
    while rest:  # windows of ``rest`` words are left to take in, from ``at`` on
        if rest & 1:
            part = power[at : at + n]
            numbers = part if numbers is None else _ranked(numbers * len(ids) + part)
            at += size
        rest >>= 1
        if rest:
            power = _ranked(power[:-size] * len(ids) + power[size:])
            size *= 2
    _, which, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    again = np.flatnonzero(counts[which] > 1)
    change[again] += 1
    change[again + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def _measured(text: str, encoding: tiktoken.Encoding, pieces: np.ndarray) -> tuple:
    names: defaultdict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    words = text.encode().split()
    ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    tokens = np.concatenate([np.empty(0, np.uint32), *(encoding.encode_to_numpy(p) for p in _parts(text))])
    counts = np.unique(tokens, return_counts=True)[1] / max(1, len(tokens))
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    letters = points[(points > 0x7F) | ((points | 0x20) - 0x61 < 26)]
    firsts, scripts = _scripts()
    which = np.bincount(np.searchsorted(firsts, letters, "right") - 1, minlength=len(firsts))
    totals = {s: which[scripts == s].sum() for s in dict.fromkeys(scripts.tolist())} if len(letters) else {}
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(tokens),
        len(text) / max(1, len(tokens)),
        float(-(counts * np.log2(counts)).sum()) + 0.0,
        float(widths[~pieces[points]].sum() / max(1, widths.sum())),
        max(totals, key=totals.get) if totals else "none",
    )


def measure(docs: DataFrame, text_col: str = "text", ranks: str = RANKS, pieces: str = PIECES) -> DataFrame:
    """``docs`` without its text, with what the rules go by.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (see ``judge``);
    n_tokens, chars_per_token and entropy (bits) in the vocabulary ``ranks``; fallback_share, the
    share of the text's bytes whose characters are no piece of ``pieces``, which falls back to
    bytes for them; script, that of most letters.

    Defined cases: null counts as empty, and an empty text measures 0 and has script ``none``; a
    stretch of more than ``STRETCH`` characters without white space, or of nothing else, is encoded
    in parts, as its whole costs the square of its length; columns of ``docs`` named like a result
    column are replaced; an empty table gives an empty one.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]] for f in _FIELDS.split(", ")]

    def measured(column: pa.Array) -> list[pa.Array]:
        encoding, known = _encoding(ranks), _in_pieces(pieces)
        rows = [_measured(text or "", encoding, known) for text in column.to_pylist()]
        values = zip(*rows, strict=True) if rows else [()] * len(names)
        return [pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)]

    return in_batches(docs, text_col, measured, _FIELDS)


def _size_class() -> Column:
    """Texts are held against those with as many characters in words, within a factor of two."""
    return F.floor(F.log2(F.greatest("word_chars", F.lit(1)))).cast("int")


def bands(measured: DataFrame, by: str) -> DataFrame:
    """Per value of ``by`` and size, the limits of each measure, from all texts that the plain
    rules pass.

    Quartiles are exact ones of values in thousandths, so a group's values stay few and are
    summed up before they are shuffled.
    """
    ends = []
    for name, least in LEAST.items():
        values = F.percentile(F.round(name, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        ends.append(values.alias(f"_{name}"))
    drawn = measured.where(~F.col("base_failed")).groupBy(F.col(by).alias("_by"), F.col("_size").alias("_of"))
    rows = drawn.agg(F.count(F.lit(1)).alias("_texts"), *ends).where(F.col("_texts") >= MIN_TEXTS)
    limits = [F.col("_by"), F.col("_of")]
    for name, least in LEAST.items():
        low, middle, high = (F.col(f"_{name}")[i] for i in range(3))
        limits.append((middle - F.greatest(WIDTH * (middle - low), F.lit(least))).alias(f"_{name}_low"))
        limits.append((middle + F.greatest(WIDTH * (high - middle), F.lit(least))).alias(f"_{name}_high"))
    # Stored, so that Spark knows the size: few rows are sent to all tasks, and documents of a
    # common language don't meet in one.
    return stored(rows.select(*limits))


def _outside(measured: DataFrame, limits: DataFrame, by: str, out: str) -> DataFrame:
    """Whether any measure lies outside the limits; null where there are none."""
    beyond = F.lit(False)
    for name in LEAST:
        beyond |= ~F.round(name, 3).between(F.col(f"_{name}_low"), F.col(f"_{name}_high"))
    on = (F.col(by) == F.col("_by")) & (F.col("_size") == F.col("_of"))
    return measured.join(limits, on, "left").withColumn(out, beyond).drop(*limits.columns)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` without its text, with the columns of ``measure`` and the verdict.

    n_words; word_chars, code points in words; n_symbols, signs of markup and of currency;
    n_dup_lines, lines with a word that equal an earlier one; n_repeat_words, words in windows of
    ``WINDOW`` words found twice or more; base_failed, too few words or too many repeated;
    kept, false if base_failed or if a measure lies outside the band of the text's language and
    size, and else true. Where ``lang_col`` is None or null, or too few texts share language and
    size, the band of the script is taken; without that one, the text is kept.

    Defined cases: as for ``measure``. Repeated rows count each time and get equal verdicts.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")] + ["base_failed", "kept"]
    rows = without(docs, [n for n in names if n.lower() != text_col.lower()])
    kept = [c for c in rows.columns if c != text_col]
    # The caller's columns go by their place, under names that nothing else has.
    language = F.lit(None).cast("string") if lang_col is None else quoted(lang_col).cast("string")
    placed = rows.select(*[quoted(c).alias(f"_c{i}") for i, c in enumerate(kept)], quoted(text_col).alias("_text"), language.alias("_lang"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = stored(
        measure(placed, "_text").withColumn("base_failed", failed).withColumn("_size", _size_class())
    )
    judged = _outside(measured, bands(measured, "_lang"), "_lang", "_by_language")
    judged = _outside(judged, bands(measured, "script"), "script", "_by_script")
    rejected = F.coalesce("_by_language", "_by_script", F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected).select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], *names
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(documents(spark, sf_dir).select("doc_id", "lang", "text")).select(
        "doc_id", *counts, "base_failed", "kept", "chars_per_token", "entropy", "fallback_share", "script"
    )
