import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import runs
from llm.runs import WaveletTree, periodic_runs

SF_DIR = "/root/testdata/sf0.001"
BLANKS = b" \t\n\r\v\f"


def by_hand(words, min_length=6, min_exponent=4):
    """Every period, every stretch of equal words that far apart."""
    out = []
    for q in range(1, len(words) // min_exponent + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i + q < len(words) and words[i] == words[i + q]:
                continue
            length = i + q - start
            if length >= max(min_length, min_exponent * q):
                part = words[start : start + length]
                if all(part[p:] != part[:-p] for p in range(1, q)):
                    out.append((start, length, q))
            start = i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def left_over(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 37, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        left = rng.integers(0, n, 200)
        right = np.minimum(n, left + rng.integers(1, n + 1, 200))
        least = rng.integers(0, n + 1, 200)
        expected = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(left, right, least)]
        assert tree.successor(left, right, least).tolist() == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), min_size=1, max_size=4))
def test_texts_together_as_by_hand(texts):
    found = list(runs._searched([b" ".join(t) for t in texts], 6, 4))
    for words, (n, rows, rest) in zip(texts, found, strict=True):
        expected = by_hand(words)
        assert (n, [tuple(r) for r in rows.tolist()]) == (len(words), expected)
        assert rest == left_over(words, expected)


def test_planted_periods():
    rng = random.Random(2)
    texts = []
    for _ in range(400):
        n = rng.randint(1, 200)
        words = [str(rng.randint(0, 60)).encode() for _ in range(n)]
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 12)
        texts.append([words[i] if i < a else words[a + (i - a) % p] for i in range(n)])
    for words, (_, rows, _) in zip(texts, runs._searched([b" ".join(t) for t in texts], 6, 4), strict=True):
        assert [tuple(r) for r in rows.tolist()] == by_hand(words)


def test_least_length_and_exponent(docs):
    frame = docs(["a a a a a a", "a a a a a", "x " + "a b " * 10, "a b c d " * 5])
    rows = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs(frame).collect()}
    assert rows == {0: [(0, 6, 1)], 1: [], 2: [(1, 20, 2)], 3: [(0, 20, 4)]}
    stricter = periodic_runs(frame, min_length=20, min_exponent=6).collect()
    assert {r["doc_id"]: len(r["runs"]) for r in stricter} == {0: 0, 1: 0, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        periodic_runs(frame, min_exponent=3)


def test_query_as_by_hand(spark):
    """All documents with the contract's parameters, the planted repetitions included."""
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.query(spark, SF_DIR).collect()}
    expected = {}
    for doc, text in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect():
        words = repeating(doc, (text or "").encode().split())
        found = by_hand(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if found else None
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        expected[doc] = (len(found), *best, milli, digest(lines.encode()), digest(left_over(words, found)))
    assert got == expected
    assert sum(r[0] > 0 for r in expected.values()) > 10


def test_awkward_texts(awkward, nothing):
    rows = periodic_runs(awkward)
    assert "text" not in rows.columns and "a.b" in rows.columns
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in rows.collect()]
    by_id = {r[0]: r[1:] for r in found if r[0] is not None}
    assert len(found) == awkward.count()
    assert by_id[1] == by_id[2] == by_id[3] == (0, [], 0)
    assert by_id[8] == (24_000, [(0, 24_000, 12)], len("The quick brown fox jumps over the lazy dog again and again."))
    assert by_id[9] == (1, [], 70_000) and by_id[10] == (20_000, [(0, 20_000, 1)], 1)
    clashing = nothing.withColumnRenamed("lang", "Runs").withColumnRenamed("source", "collapsed")
    assert periodic_runs(clashing).collect() == []
    assert periodic_runs(clashing).columns == ["doc_id", "n_chars", "n_words", "runs", "collapsed"]


def test_other_white_space(docs):
    """Only ASCII white space parts words."""
    text = "a b " * 6 + "\t\v\f\r\n" + "c " * 3
    rows = periodic_runs(docs([text])).collect()
    assert rows[0]["n_words"] == len(text.encode().split()) == 7
    assert [tuple(r) for r in rows[0]["runs"]] == [(0, 6, 1)]
