import random
import re

import regex

from llm.licenses import _FORMS, CONTAINMENT, TEMPLATES, bands_needed, scan_licenses, window_size


def shingles(text):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def test_as_by_hand(docs):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet under the license".split()) for _ in range(n))
    texts = [words(rng.randrange(80)) for _ in range(30)]
    for text in TEMPLATES.values():
        for _ in range(8):
            body = text.split()
            for _ in range(rng.randrange(1 + len(body) // 25)):
                body[rng.randrange(len(body))] = "changed"
            texts.append(f"{words(rng.randrange(90))} {' '.join(body).upper()} {words(rng.randrange(90))}")
    expected = set()
    for i, text in enumerate(texts):
        for name, template in TEMPLATES.items():
            own = shingles(template)
            if len(own & shingles(text)) >= CONTAINMENT * len(own):
                expected.add((i, name))
    rows = scan_licenses(docs(texts)).collect()
    assert {(r["doc_id"], r["license"]) for r in rows} == expected and len(rows) == len(expected)
    for r in rows:
        place = regex.findall(r"[\p{L}\p{N}]+", texts[r["doc_id"]].lower())[r["first_word"] : r["last_word"] + 1]
        own = shingles(TEMPLATES[r["license"]])
        assert len(own & shingles(" ".join(place))) / len(own) == r["containment"]


def test_bands_reach_the_recall():
    for n in range(1, 200):
        size, shared = window_size(n), -(-4 * n // 5)
        assert 2 * n <= size < 4 * n
        assert 1 - (1 - shared / (size + n - shared)) ** bands_needed(n) >= 0.9999


def test_rivals_over_the_same_words(docs):
    names = sorted(TEMPLATES)
    plain = scan_licenses(docs([TEMPLATES[n] for n in names]), decide=True).collect()
    found = {}
    for r in plain:
        found.setdefault(names[r["doc_id"]], set()).add(re.sub(_FORMS, "", r["license"]))
    assert found == {n: {re.sub(_FORMS, "", n)} for n in names}
    both = f"{TEMPLATES['GPL-3.0-header']} lorem ipsum {TEMPLATES['GPL-2.0-header']}"
    gpl_2 = TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2")
    rows = scan_licenses(docs([both, gpl_2]), decide=True).collect()
    assert sorted((r["doc_id"], r["license"], r["containment"]) for r in rows) == [
        (0, "GPL-2.0-header", 1), (0, "GPL-3.0-header", 1), (1, "GPL-2.0-header", 1)
    ]


def test_awkward_rows(awkward, nothing, docs):
    assert scan_licenses(awkward).collect() == []
    assert scan_licenses(nothing).collect() == []
    assert scan_licenses(docs(["a b c"]), {"short": "a b c"}).collect() == []
    twice = docs([(1, "Released under the MIT License.")] * 2 + [(None, "x released UNDER the MIT license")])
    found = scan_licenses(twice).collect()
    assert sorted((str(r["doc_id"]), r["first_word"]) for r in found) == [("1", 0), ("1", 0), ("None", 1)]


def test_no_python_in_the_plan(docs, capsys):
    scan_licenses(docs(["a"])).explain()
    assert "Python" not in capsys.readouterr().out
