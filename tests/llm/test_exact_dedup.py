import hashlib
from collections import defaultdict

from llm.exact_dedup import drop_duplicates, exact_dedup


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_groups_as_by_hand(docs):
    texts = ["A b", "a B", "a b ", None, "", "É", "é", "x" * 300 + "1", "x" * 300 + "2", "X" * 300 + "1"]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    expected = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    found = exact_dedup(docs(texts)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == expected


def test_short_prefix_still_compares_whole_texts(docs):
    found = exact_dedup(docs(["aaaa1", "aaaa2", "aaaa2"]), prefix_chars=2).collect()
    assert sorted((r["doc_id"], r["group_size"]) for r in found) == [(0, 1), (1, 2), (2, 2)]


def test_awkward_rows(awkward):
    found = exact_dedup(awkward)
    assert found.count() == awkward.count()
    assert "a.b" in found.columns and found.columns.count("kept") == 1 and "KEEP_ID" not in found.columns
    kept = found.where("kept").collect()
    assert sorted((r["doc_id"], r["group_size"]) for r in kept if r["text"] and "quick" in r["text"].lower()) == [(7, 6), (8, 1)]
    # Nulls and the empty text are one group; the largest id stays.
    assert [(r["doc_id"], r["group_size"]) for r in kept if not r["text"]] == [(2, 4)]
    assert set(drop_duplicates(awkward).columns) == set(awkward.columns)


def test_repeated_row_stays_once(docs):
    found = exact_dedup(docs([(5, "t"), (5, "t"), (None, "u"), (None, "u")]))
    assert sorted(str(r["doc_id"]) for r in found.where("kept").collect()) == ["5", "None"]


def test_empty_table(nothing):
    assert exact_dedup(nothing).collect() == []
