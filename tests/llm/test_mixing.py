import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from llm.mixing import domain, mix_sources

def path():
    return [F.col("domain"), F.col("lang"), F.col("source")]


SCHEMA = "doc_id long, text string, domain string, lang string, source string"


def fill(children, budget):
    """Water-filling by hand: (cap, weight) per name; overfull children give back."""
    got, open_ = {}, {n: c for n, c in children.items() if c[1] > 0}
    while open_:
        level = Fraction(budget - sum(got.values()), sum(w for _, w in open_.values()))
        full = [n for n, (cap, w) in open_.items() if cap <= w * level]
        if not full:
            order = sorted(open_, key=lambda n: (open_[n][0] / open_[n][1], n))
            shares = {n: int(open_[n][1] * level) for n in order}
            spare = budget - sum(got.values()) - sum(shares.values())
            return got | {n: s + (i < spare) for i, (n, s) in enumerate(shares.items())}
        for n in full:
            got[n] = open_.pop(n)[0]
    return got


def by_hand(rows, weights, share, epochs, seed):
    size = lambda t: len((t or "").split())
    leaves = {}
    for r in rows:
        leaf = tuple(x or "" for x in r[2:5])
        if all(weights[depth].get(name, 1) for depth, name in enumerate(leaf)):
            leaves.setdefault(leaf, []).append(r)
    total = {k: sum(size(r[1]) for r in v) for k, v in leaves.items()}
    budgets = {(): min(sum(total.values()) * share[0] // share[1], sum(total.values()) * epochs)}
    for depth in range(3):
        new = {}
        for parent, budget in budgets.items():
            names = {k[depth] for k in total if k[:depth] == parent}
            caps = {n: sum(t * epochs for k, t in total.items() if k[: depth + 1] == (*parent, n)) for n in names}
            got = fill({n: (caps[n], weights[depth].get(n, 1)) for n in names}, budget)
            new |= {(*parent, n): got.get(n, 0) for n in names}
        budgets = new
    out = []
    for leaf, members in leaves.items():
        if not budgets[leaf]:
            continue
        whole, rest = divmod(budgets[leaf], total[leaf])
        out += [(r[0], e, size(r[1])) for r in members for e in range(whole)]
        order = sorted(members, key=lambda r: (hashlib.md5(f"{seed}:{whole}:{r[0]}".encode()).hexdigest(), r[0]))
        for r in order:
            if rest <= 0:
                break
            out.append((r[0], whole, min(rest, size(r[1]))))
            rest -= size(r[1])
    return sorted(out, key=lambda x: (str(type(x[0])), x))


def test_as_by_hand(kept):
    rows = [
        (i, "w " * (i * 7 % 13 + 1), ["web", "book"][i % 7 == 0], ["en", "fr", None][i % 3], f"s{i * i % 5}")
        for i in range(200)
    ]
    weights = ({"web": 3, "book": 2}, {"en": 2, "": 0}, {"s0": 4})
    for share, epochs in (((1, 2), 1), ((9, 10), 2), ((3, 1), 2), ((3, 2), 4)):
        found = mix_sources(kept(rows, SCHEMA), path(), weights, share, epochs, seed=3)
        got = sorted((r["doc_id"], r["epoch"], r["taken"]) for r in found.collect())
        assert got == by_hand(rows, weights, share, epochs, 3)


def test_budget_is_met_to_the_token(kept):
    rows = [(i, "w " * (i % 9 + 1), "d", "en", f"s{i % 4}") for i in range(300)]
    total = sum(i % 9 + 1 for i in range(300))
    found = mix_sources(kept(rows, SCHEMA), path(), ({}, {}, {}), (2, 3), 1)
    assert found.agg(F.sum("taken")).first()[0] == total * 2 // 3


def test_closed_branches_lose_no_tokens(kept):
    rows = [(i, "w w", "d", ["en", "fr"][i % 2], f"s{i % 3}") for i in range(120)]
    found = mix_sources(kept(rows, SCHEMA), path(), ({}, {"fr": 0}, {"s0": 0}), (1, 2), 1)
    assert {(r["lang"], r["source"]) for r in found.collect()} == {("en", "s1"), ("en", "s2")}
    assert found.agg(F.sum("taken")).first()[0] == 40  # half of 40 texts of two words
    nested = mix_sources(kept(rows, SCHEMA), path(), ({}, {}, {"s0": 0}), (1, 1), 1)
    assert nested.agg(F.sum("taken")).first()[0] == 160


def test_awkward_rows(awkward, nothing):
    names = [domain(F.col("source")), F.col("lang"), F.col("source")]
    found = mix_sources(awkward, names, ({}, {}, {}), (1, 1), 1)
    words = awkward.where("text is not null").selectExpr("sum(size(regexp_extract_all(text, '[^ \\t\\n]+', 0)))").first()[0]
    assert found.agg(F.sum("taken")).first()[0] == words
    assert "a.b" in found.columns and found.schema["epoch"].dataType.simpleString() == "bigint"
    assert mix_sources(nothing, names, ({}, {}, {})).collect() == []
