import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm import pii
from llm.pii import KINDS, PATTERNS, disclosing_terms, find_entities, mark_terms, sanitise

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def by_hand(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def base(row):
    return [tuple(s[c] for c in ("s", "rank", "e", "kind")) for s in row["spans"] if s["kind"] != "term"]


CASES = [
    None, "", "1.2.3.4.5.6.7.8", "a@b.c%x@y.z", "a@b.c.@x.y", "a@b.c_d@e.f é a@é.b", "@@a@@b.c@d.e..f@g.h-i.j-",
    "4111 1111 1111 1111 4111-1111-1111-1111", "card 4111-1111-1111-1111.", "12--4111111111111111 -4111111111111111-",
    "+1 (555) 555-5555+1 2 3 4 5 6 7 8 9 0 1", "+1((((((((((((2", "😀 a@b.co 😀 1.1.1.1 256.1.1.1 001.02.3.4",
    "x" * 50_000, "1" * 60_000, "a.b" * 20_000 + "@c.d", "0 " * 30_000, "a@" + "b." * 20_000 + "c", "+1 " * 9_000,
]


def test_base_spans_as_by_hand(docs):
    rows = {r["doc_id"]: r for r in sanitise(docs(CASES)).collect()}
    for i, text in enumerate(CASES):
        assert base(rows[i]) == by_hand(text), text and text[:60]


@given(st.lists(st.text("09 1.-+()@ab%é4\n", max_size=60), max_size=40))
@settings(max_examples=12, deadline=None)
def test_base_spans_of_any_text(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_entities(frame).collect():
        assert [(s["s"], s["rank"], s["e"], s["kind"]) for s in r["_spans"]] == by_hand(texts[r["doc_id"]])


def test_words_that_give_an_entity_away(docs):
    plain = "ordinary words stand here without any meaning whatever"
    texts = [f"{w} Zebulon wrote from zeb@mail.org about {w}ish plans" for w in ("alpha", "bravo", "carol", "delta")]
    texts += [f"Common note {w} from {w}@mail.org today" for w in ("anna", "berta", "clara", "dora", "emma", "frida")]
    texts += [plain] * 30 + ["Common " + plain] * 20
    frame = docs(texts)
    rows = {r["doc_id"]: r for r in sanitise(frame).collect()}
    terms = {i: [frame_text(texts[i], s) for s in rows[i]["spans"] if s["kind"] == "term"] for i in range(len(texts))}
    assert all("Zebulon" in terms[i] and "Common" not in terms[i] for i in range(4))
    assert not any(terms[i] for i in range(4, len(texts)))
    assert "Zebulon" not in rows[0]["sanitised"] and "[EMAIL]" in rows[0]["sanitised"]
    assert rows[20]["sanitised"] == plain


def frame_text(text, span):
    return text[span["s"] : span["e"]]


def test_shares_from_counts(docs, spark):
    texts = [f"{w} Zebulon wrote from zeb@mail.org" for w in ("alpha", "bravo", "carol")] + ["Zebulon", "none"] * 2
    frame = docs(texts)
    from pyspark.sql import functions as F

    found = find_entities(frame).withColumn("_row", F.monotonically_increasing_id())
    shares = {r["term"]: r["share"] for r in disclosing_terms(found, frame).collect()}
    import math

    n, n_e = 7, 3
    share = lambda n_t, n_te: math.log(n_te * n / (n_t * n_e)) / math.log(n / n_e)
    assert abs(shares["wrote"] - share(3, 3)) < 1e-9 and shares["wrote"] == 1
    assert "zebulon" not in shares and share(5, 3) < 0.6


def test_words_of_the_whole_text_of_any_length(docs):
    far = "plain words " * 20
    texts = [f"Bo Zebulon {w} {far} zeb@mail.org {far} ZEBULON and BO" for w in ("alpha", "bravo")]
    rows = {r["doc_id"]: r for r in sanitise(docs(texts + [far + "and more"] * 3 + [f"and {i}" for i in range(40)])).collect()}
    for i, text in enumerate(texts):
        marked = [text[s["s"] : s["e"]] for s in rows[i]["spans"] if s["kind"] == "term"]
        assert [w for w in marked if w.lower() in ("bo", "zebulon")] == ["Bo", "Zebulon", "ZEBULON", "BO"]
        assert "and" not in marked and "zebulon" not in rows[i]["sanitised"].lower()


def test_words_around_rare_entities_of_one_domain(docs):
    texts = [f"{w} of Quuxcorp asks {w}.x@desk.quux.net" for w in ("anna", "berta", "clara")]
    texts += [f"plain note number {i} asks nothing of anyone" for i in range(200)]
    rows = {r["doc_id"]: r for r in sanitise(docs(texts)).collect()}
    for i in range(3):
        assert [frame_text(texts[i], s) for s in rows[i]["spans"] if s["kind"] == "term"] == ["Quuxcorp"]
        assert rows[i]["sanitised"] == f"{texts[i].split()[0]} of  asks [EMAIL]"
    assert all(rows[i]["sanitised"] == texts[i] for i in range(3, len(texts)))


def test_rows_of_a_common_domain_meet_only_the_terms_they_say(docs, spark, monkeypatch):
    names = [a + b for a in "abcdef" for b in "uvwxyz"]
    found = find_entities(docs([f"{n} asks {n}@mail.org" for n in names]))
    terms = spark.createDataFrame([("email:@mail.org", n, 1.0) for n in names], "entity string, term string, share double")
    written = []
    monkeypatch.setattr(pii, "stored", lambda df, stored=pii.stored, **options: written.append(stored(df, **options)) or written[-1])
    rows = mark_terms(found, terms).collect()
    assert len(rows) == len(names) and all([(t["s"], t["e"]) for t in r["_terms"]] == [(0, 2)] for r in rows)
    assert [f.count() for f in written] == [len(names)] * 2


def sanitised_by_hand(text, spans):
    """A pattern of what may be left, as a span doesn't tell a word's share."""
    out, at = "", 0
    for s in spans:
        if s["s"] >= at:
            by = r"(?:|\[WORD\])" if s["kind"] == "term" else re.escape(f"[{s['kind'].upper()}]")
            out += re.escape(text[at : s["s"]]) + by
        at = max(at, s["e"])
    return out + re.escape(text[at:])


def test_sanitised_as_by_hand_over_block_ends(docs):
    texts = [f"{'é😀' * n}a@b.co 1.2.3.4@x.yz {'- ' * n}+1 (555) 555-5555" for n in (0, 300, 507, 508, 509, 510, 511, 512, 700)]
    texts += [c for c in CASES if c and len(c) < 100]
    for r in sanitise(docs(texts)).collect():
        assert re.fullmatch(sanitised_by_hand(texts[r["doc_id"]], r["spans"]), r["sanitised"])


def test_very_many_matches_in_a_text(docs):
    text = "1.2.3.4 " * 100_000
    row = sanitise(docs([text, "plain"])).where("doc_id = 0").first()
    assert len(row["spans"]) == 100_000 and row["spans"][-1]["e"] == len(text) - 1
    assert row["sanitised"] == "[IP] " * 100_000


def test_copies_are_no_evidence(docs):
    found = sanitise(docs(["Zebulon wrote from zeb@mail.org"] * 9 + ["none"] * 5)).collect()
    assert not any(s["kind"] == "term" for r in found for s in r["spans"])


def test_awkward_rows(awkward, nothing):
    found = sanitise(awkward)
    assert found.count() == awkward.count() and found.columns.count("spans") == 1
    assert sanitise(nothing).collect() == []
    assert set(PATTERNS) == set(KINDS)


def test_query_returns_the_sanitised_text(spark):
    import hashlib

    from llm.pii import query

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    made = {r["doc_id"]: r["sanitised"] for r in sanitise(docs).collect()}
    rows = query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        spans = by_hand(text)
        listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[3] == k for x in spans) for k in KINDS]
        assert r["sanitised_sha256"] == hashlib.sha256(made[r["doc_id"]].encode()).hexdigest()
        assert r["sanitised_chars"] == len(made[r["doc_id"]]) and (spans or made[r["doc_id"]] == text)


def test_no_python_in_the_plan(docs, capsys):
    sanitise(docs(["a@b.co"])).explain()
    assert "Python" not in capsys.readouterr().out
