import numpy as np
from pyspark.sql import functions as F

from llm.topk import CoverTree, top_k

SCHEMA = "vec_id long, embedding array<float>, label string, score string"


def by_hand(rows, asks, k, scale=64):
    ok = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            ok.append((i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]))
    out = set()
    for q, v in ok:
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def found(frame, k, **more):
    rows = top_k(frame, F.col("vec_id") % 5 == 0, k, **more).collect()
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows}


def test_as_by_hand_in_many_blocks(kept):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8)) * 3
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + rng.normal(size=8) * 0.2]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # ties
    frame = kept([(i, v, "x", "y") for i, v in rows], SCHEMA)
    for block in ((8192, 1024), (50, 17)):
        assert found(frame, 7, data_block=block[0], query_block=block[1]) == by_hand(rows, lambda q: q % 5 == 0, 7)


def test_tree_covers_and_nests():
    points = np.random.default_rng(2).normal(size=(3000, 5))
    tree = CoverTree(points, leaf=10)
    for node, rows in enumerate(tree.rows):
        gaps = np.sqrt(((points[rows] - tree.centers[node]) ** 2).sum(axis=1))
        assert gaps.max() <= tree.radii[node] + 1e-9 and tree.at[node] in rows
        if len(tree.children[node]):
            assert sorted(np.concatenate([tree.rows[c] for c in tree.children[node]])) == sorted(rows)


def test_awkward_vectors(kept):
    rows = [
        (0, [1.0, 2.0]), (1, None), (5, [None, 1.0]), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]),
        (None, [1.0, 1.0]), (2, [1.0]), (3, [2.0, 2.0]), (4, [2.0, 2.0]), (20, []), (25, []), (30, [1e9, -1e9]),
        (35, [-1e9, 1e9]),
    ]
    frame = kept([(i, v, "x", "y") for i, v in rows], SCHEMA)
    assert found(frame, 3) == by_hand(rows, lambda q: q % 5 == 0, 3)
    assert found(kept([], SCHEMA, parts=1), 3) == set()
