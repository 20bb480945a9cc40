import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from llm import fertility
from llm.fertility import judge, measure, repeated_words

SF_DIR = "/root/testdata/sf0.001"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    repeated = by_hand(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        repeated,
        len(words) < 10 or 100 * repeated > 20 * len(words),
    )


def by_hand(words, window=5):
    all_of = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    places = {}
    for i, w in enumerate(all_of):
        places.setdefault(w, []).append(i)
    return len({i + j for at in places.values() if len(at) > 1 for i in at for j in range(window)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 7))
def test_repeated_words(ids, window):
    names = {v: i for i, v in enumerate(dict.fromkeys(ids))}
    assert repeated_words(np.array([names[i] for i in ids], dtype=np.int64), window) == by_hand(ids, window)


def test_query_base_columns_as_by_hand(spark):
    rows = fertility.query(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {d: base(t) for d, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_measures(docs):
    text = "Plain words, and again plain words."
    row = measure(docs([text])).first()
    tokens = fertility._encoding(fertility.RANKS).encode_ordinary(text)
    shares = np.array([tokens.count(t) for t in set(tokens)]) / len(tokens)
    assert row["n_tokens"] == len(tokens) and row["chars_per_token"] == pytest.approx(len(text) / len(tokens))
    assert row["entropy"] == pytest.approx(-(shares * np.log2(shares)).sum())
    assert row["fallback_share"] == 0 and row["script"] == "latin"


def test_fallback_share_is_what_the_piece_vocabulary_falls_back_for(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("漢字かな 𓀀𓂀 abc", "смысл 😀 слова", "ሰላም ሰላም", "plain"):
        row = measure(docs([text])).first()
        fallen = sum(model.is_byte(i) for i in model.encode(text))
        assert row["fallback_share"] == pytest.approx(fallen / len(text.encode()))


def test_bands_reject_what_is_unlike_its_language(docs, kept):
    rng = random.Random(4)
    words = "the quick brown fox jumps over lazy dogs while seven green apples fall from old trees near our quiet river house".split()
    russian = "быстрая лиса прыгает через ленивую собаку пока семь зелёных яблок падают со старых деревьев у тихого дома".split()
    said = lambda of, n: " ".join(rng.choice(of) for _ in range(n))
    rows = [(i, said(words, 120), "en", "s", None) for i in range(120)]
    rows += [(200 + i, said(russian, 120), "ru", "s", None) for i in range(120)]
    rows += [(400, " ".join(w.upper() + "!!" for w in said(words, 120).split()), "en", "s", None)]
    rows += [(401, said(russian, 120), "en", "s", None), (402, said(words, 120), None, "s", None)]
    rows += [(403, " ".join(map(chr, range(0x6F00, 0x6F60))), "zh", "s", None), (404, "too few words", "en", "s", None)]
    out = {r["doc_id"]: r["kept"] for r in judge(kept(rows)).collect()}
    assert not out[400] and not out[401] and not out[404]
    assert out[402]  # no language: held against its script
    assert out[403]  # nothing to hold it against
    assert sum(out[i] for i in range(120)) >= 117 and sum(out[200 + i] for i in range(120)) >= 117


def test_verdict_against_labels(spark):
    """Labels are no input; most documents labelled poor go, nearly all others that pass the
    plain rules stay."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = fertility.query(spark, sf_dir).join(labels, "doc_id").where("NOT base_failed").collect()
    poor = [r["kept"] for r in rows if r["quality"] == 0]
    fine = [r["kept"] for r in rows if r["quality"] == 1]
    assert len(poor) > 200 and sum(poor) < 0.25 * len(poor)
    assert len(fine) > 2000 and sum(fine) > 0.99 * len(fine)


def test_awkward_texts(awkward, nothing):
    rows = judge(awkward)
    assert "text" not in rows.columns and "a.b" in rows.columns and rows.columns.count("kept") == 1
    found = rows.collect()
    assert len(found) == awkward.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i in (1, 2, 3):
        assert (by_id[i]["n_words"], by_id[i]["n_repeat_words"], by_id[i]["script"], by_id[i]["kept"]) == (0, 0, "none", False)
    assert by_id[9]["n_words"] == 1 and by_id[9]["word_chars"] == 70_000
    assert by_id[10]["n_repeat_words"] == 20_000 and by_id[10]["base_failed"]
    assert judge(nothing).collect() == []
    assert judge(nothing.drop("lang"), lang_col=None).collect() == []


def test_long_stretches_are_encoded_in_parts(docs):
    texts = ["x" * 300_000, " " * 300_000, "漢" * 100_000 + " end"]
    rows = {r["doc_id"]: r for r in measure(docs(texts)).collect()}
    assert [rows[i]["n_words"] for i in range(3)] == [1, 0, 2]
    assert rows[0]["word_chars"] == 300_000 and rows[2]["script"] == "han"
