import random

from llm.toxicity import Lexicon, fold, fold_phrase, learn, matches, score_toxicity, strength, training_rows

CLOWN, LOWEI = fold_phrase("clown"), fold_phrase("lowei").rstrip()
LEXICON = Lexicon(((" idiot ", 7.0), (LOWEI, 5.0)), (fold_phrase("clown fish"),), 1.0)


def test_folding():
    assert fold("1D10T іdіоt ｉｄｉｏｔ i​diot") == " idiot idiot idiot idiot "
    assert fold("a-b, É!") == " a b  é  "
    assert fold(None) == fold("") == "  "


def test_matching_words_beginnings_and_exceptions():
    whole = fold_phrase("loweiß")
    spared = (fold_phrase("Clown  fish"), fold_phrase("the clown"))
    lexicon = Lexicon(((CLOWN, 3.0), (LOWEI, 5.0), (whole, 6.0)), spared, 1.0)
    found = lambda text: [p for _, p, _ in matches(fold(text), lexicon)]
    assert found("clown Clown c10wn") == [CLOWN] * 3
    assert found("a clown fish, the clown") == []
    assert found("clowns xlowei") == []
    assert found("loweiß loweiung") == [whole, LOWEI]
    assert strength("clown " + "word " * 1000, lexicon) < strength("clown", lexicon)


def test_learning_finds_words_stems_and_exceptions(docs, spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["zorgon", "Z0RGON", "quex" + word()])
        elif i % 5 == 0:
            words[9:11] = ["happy", "zorgon"]
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame([*labels, (None, 1), (3, None), (99_999, 1)], "doc_id long, toxic int")
    frame = docs(texts)
    lexicon = learn(training_rows(frame, table))
    patterns = dict(lexicon.terms)
    assert any(p.startswith(" quex") for p in patterns) and " zorgon " in patterns
    assert " happy zorgon " in lexicon.exceptions
    found = score_toxicity(frame, lexicon).collect()
    right = sum(r["predicted"] == labels[r["doc_id"]][1] for r in found)
    assert right >= 0.95 * len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_no_term_is_left_out_for_being_one_of_many(spark):
    """A lexicon of more terms and phrases than any fixed number would let through."""
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    bad = [f"zz{name(i)}" for i in range(6_000)]
    rows = [(" ".join(f"x {w}" for w in bad), 1)] * 12 + [(f"plain {name(i)}", 0) for i in range(40)]
    lexicon = learn(spark.createDataFrame(rows, "text string, toxic int"))
    terms = [p.strip() for p, _ in lexicon.terms]
    covered = sum(any(w.startswith(p) for p in terms if p.startswith("zz")) for w in bad[::97])
    assert covered == len(bad[::97])


def test_held_out_rows_are_not_learned_from(docs, spark):
    import zlib

    table = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = training_rows(docs([f"w{i} " * 8 for i in range(60)]), table).collect()
    seen = {int(r["text"].split()[0][1:]) for r in rows}
    assert seen == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}


def test_nothing_to_learn(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = learn(training_rows(docs(["a b"]), none))
    assert lexicon == Lexicon()
    assert score_toxicity(docs(["idiot"]), lexicon).first()["score"] == 0
    assert score_toxicity(nothing, LEXICON).collect() == []


def test_awkward_rows(awkward):
    found = score_toxicity(awkward, LEXICON)
    assert found.count() == awkward.count() and found.schema["score"].dataType.simpleString() == "double"
    assert all(r["score"] == 0 for r in found.collect())
