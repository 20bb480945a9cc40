import random
import re

import numpy as np
import pyarrow as pa

from llm import jaccard_join
from llm.components import connected
from llm.jaccard_join import bands, drop_near_duplicates, jaccard_components, mark_bytes, maybe_similar, shingle_sets, signatures
from tests.llm.conftest import thue_morse


def shingles(text, n=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if 0 < len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def by_hand(pairs):
    sets = [shingles(t) for _, t in pairs]
    group = list(range(len(pairs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    links = [0] * len(pairs)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(pairs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)], links[i]) for i, (doc, _) in enumerate(pairs)}


def corpus(rng, copies):
    vocabulary = [f"w{i}" for i in range(200)]
    passage, texts = [rng.choice(vocabulary) for _ in range(40)], []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 9, 14, 30, 60, 150, 300]))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words + passage * (rng.random() < 0.4)))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(120)] = f"q{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts, strict=True))


def told(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows}


def test_components_as_by_hand(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 60)  # the large group takes many blocks
    pairs = corpus(random.Random(5), 150)
    rows = jaccard_components(docs(pairs)).collect()
    expected = by_hand(pairs)
    assert told(rows) == expected
    assert sorted(r["component_id"] for r in rows if r["first"]) == sorted({c for _, c, _ in expected.values()})


def test_blocks_are_bounded_by_shingles_too(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2_000)
    pairs = corpus(random.Random(6), 90)
    assert told(jaccard_components(docs(pairs)).collect()) == by_hand(pairs)


def test_large_clusters_meet_in_passes_that_drop_their_shuffle(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    monkeypatch.setattr(jaccard_join, "MARKED", 2)
    monkeypatch.setattr(jaccard_join, "ROOM", 0)
    monkeypatch.setattr(jaccard_join, "ROOM_LEAST", 100_000)
    passes, in_turn = [], jaccard_join.stored_in_turn

    def counted(frames):
        frames = list(frames)
        passes.append(len(frames))
        return in_turn(frames)

    monkeypatch.setattr(jaccard_join, "stored_in_turn", counted)
    pairs = corpus(random.Random(7), 120)
    assert told(jaccard_components(docs(pairs)).collect()) == by_hand(pairs)
    # Marks, which take a thirtieth of the room, and sets.
    assert len(passes) == 2 and passes[0] < passes[1] and passes[1] > 3


def test_what_only_chance_holds_together_is_sifted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rng = random.Random(11)
    many = [[str(rng.randrange(10**6)) for _ in range(rng.choice([20, 90, 700]))] for _ in range(150)]
    near = [[*many[0][:-1], f"n{i}"] for i in range(9)]
    texts = [" ".join(words).encode() for words in [*many, *near, *many[1:4]]]
    sizes = [len(t.split()) - 4 for t in texts]
    rows = [(i, 7 if i < 159 else 8, int(np.searchsorted(bands(80), n)), n, 1) for i, n in enumerate(sizes)]
    members = spark.createDataFrame(rows, "row long, cluster long, band int, n long, copies long")
    given = spark.createDataFrame(list(enumerate(texts)), "row long, text binary")
    left = jaccard_join._sift(given, members, 5, 80, 10**9).collect()
    assert sorted(r["row"] for r in left) == [0, *range(150, 162)]
    assert len({r["cluster"] for r in left if r["row"] < 159}) == 1
    assert {r["cluster"] for r in left if r["row"] >= 159} == {8}


def test_marks_part_unrelated_sets_and_no_similar_ones():
    rng = np.random.default_rng(12)
    for trial in range(300):
        size = int(rng.choice([1, 4, 5, 9, 20, 63, 64, 65, 130, 500, 3000]))
        a = rng.integers(1, 2**63, size, dtype=np.uint64)
        away = int(rng.integers(0, size // 8 + 2))
        b = np.concatenate([a[away:], rng.integers(1, 2**63, int(rng.integers(0, size // 8 + 2)), dtype=np.uint64)])
        other = rng.integers(1, 2**63, size, dtype=np.uint64)
        sets = [np.sort(x) for x in (a, b, other) if len(x)]
        sizes = np.array([len(x) for x in sets])
        marks = mark_bytes(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), len(sets))
        assert all(len(m) * 8 < 2 * max(n, 64) for m, n in zip(marks, sizes, strict=True))
        may = maybe_similar([np.frombuffer(m, "<u8") for m in marks], sizes)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            assert may[0, 1] and may[1, 0], (trial, size)
        assert not may[0, -1] or size < 9


def test_unrelated_sets_hardly_share_signatures():
    rng = np.random.default_rng(13)
    common = 0
    for _ in range(200):
        a, b = rng.integers(1, 2**63, (2, 800), dtype=np.uint64)
        b[:30] = a[:30]
        owner, signs = signatures(
            np.repeat([0, 1], 800), np.concatenate([np.sort(a), np.sort(b)]), 2, np.empty(0, np.uint64)
        )
        common += len(set(signs[owner == 0]) & set(signs[owner == 1]))
    assert common < 5  # 25 where parts of one element sign, too


def test_links_of_a_forest_hold_together_what_all_links_do():
    rng = np.random.default_rng(14)
    for n in (1, 2, 30, 60):
        similar = rng.random((n, n)) < 1 / n
        similar = np.triu(similar, 1)
        similar |= similar.T
        links = jaccard_join.forest(similar)
        reach, trees = np.linalg.matrix_power((similar | np.eye(n, dtype=bool)).astype(float), n) > 0, np.eye(n, dtype=bool)
        for i, j in links:
            assert similar[i, j]
            trees[i, j] = trees[j, i] = True
        assert (np.linalg.matrix_power(trees.astype(float), n) > 0).tolist() == reach.tolist()
        assert len(links) == n - len(np.unique(reach, axis=0))


def test_words_whose_hashes_collide(docs):
    pairs = []
    for n, size in enumerate((1024, 2048, 4096)):
        one, other = thue_morse(size)
        pairs += [(10 * n + 1, f"w1 w2 w3 w4 {one}"), (10 * n + 2, f"w1 w2 w3 w4 {other}")]
        pairs += [(10 * n + 3, f"W1 w2 w3 w4 {one}"), (10 * n + 4, f"a{n} b c d {one} e f")]
    assert told(jaccard_components(docs(pairs, parts=1)).collect()) == by_hand(pairs)


def test_query_as_by_hand(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    expected = by_hand([tuple(r) for r in rows])
    assert told(jaccard_join.query(spark, path).collect()) == expected
    assert any(links for *_, links in expected.values())


def test_bytes_shipped_hardly_grow_with_the_buckets():
    rng = random.Random(9)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([20, 300, 2000]))) for _ in range(3000)]
    size = sum(map(len, texts))
    batch = pa.record_batch([pa.array([t.encode() for t in texts], pa.binary())], names=["text"])
    shipped = []
    for buckets in (51, 1_250, 40_000):
        frames = list(jaccard_join._signed(iter([batch]), 5, 80, np.empty(0, np.uint64), buckets))
        # Spark's own part of a row, too.
        shipped.append(sum(f.nbytes + 32 * f.num_rows for f in frames) / size)
    assert shipped[0] < 1.2 and shipped[2] < 3 * shipped[0]


def test_similar_sets_share_a_signature_whatever_is_frequent():
    rng = np.random.default_rng(7)
    for trial in range(400):
        size = int(rng.choice([1, 2, 4, 5, 8, 12, 20, 45, 70, 130, 400]))
        a = rng.integers(1, 2**63, size, dtype=np.uint64)
        away = int(rng.integers(0, size // 9 + 2))
        b = np.concatenate([a[away:], rng.integers(1, 2**63, int(rng.integers(0, size // 9 + 2)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(np.unique(a)) + len(np.unique(b)) - both):
            continue
        frequent = np.unique(rng.choice(a, int(len(a) * rng.choice([0, 0.3, 0.7, 1]))))
        owner = np.repeat([0, 1], [len(a), len(b)])
        found = np.concatenate([np.sort(a), np.sort(b)])
        owner, signs = signatures(owner, found, 2, frequent)
        assert set(signs[owner == 0]) & set(signs[owner == 1]), (trial, size)


def test_shingle_sets_like_words():
    texts = ["", " ", "a", "A  b\tc\nd", "a b c d e", "a b c d e f a b c d e", "É é x\x0by z"]
    owner, found = shingle_sets([memoryview(t.encode()) for t in texts])
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(found)) == len(set().union(*map(shingles, texts)))


def test_bands_keep_similar_sizes_together():
    tops = bands(80)
    for size in range(1, 3000):
        assert np.searchsorted(tops, size * 100 // 80) - np.searchsorted(tops, size) in (0, 1)


def test_connected(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r["vertex"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {v: v for ab in links for v in ab}
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {v: group[v] for a, b in links if a != b for v in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_awkward_rows(awkward, nothing):
    found = jaccard_components(awkward)
    rows = found.collect()
    assert len(rows) == awkward.count() and found.columns.count("first") == 1
    told = sorted((str(r["doc_id"]), str(r["component_id"]), r["n_shingles"]) for r in rows if r["text"] and "uick" in r["text"].lower())
    assert {t[1] for t in told} == {"5"}
    assert [r["component_id"] for r in rows if not (r["text"] or "").strip()] == [
        r["doc_id"] for r in rows if not (r["text"] or "").strip()
    ]
    assert drop_near_duplicates(awkward).columns == awkward.columns
    assert jaccard_components(nothing).collect() == []
