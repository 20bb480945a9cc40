"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and data are dealt into blocks; a pair of blocks is one group of work. Both
blocks are indexed by a cover tree. A query node meets the data nodes that its parent
couldn't rule out: a data node goes when the largest inner product that both covering
radii allow stays below the worst k-th score of the queries in the node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import quoted, shipped

#: Rows of data and queries per block; vectors in a leaf; children of a node at most.
DATA_BLOCK, QUERY_BLOCK, LEAF, FAN_OUT = 8192, 1024, 48, 16

_MAX = 2**63 - 1


class CoverTree:
    """A cover tree over float vectors, built from the top, as arrays over its nodes.

    A node's children are centered on rows of the node, the node's own center first and
    then the row farthest from all centers so far. So children nest, lie apart by at least
    the radius that they leave uncovered, and every row belongs to its nearest center. A
    node has ``FAN_OUT`` children at most and knows the radius that really covers its rows.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.rows, self.children = points, [], []
        self.sizes = np.sqrt((points**2).sum(axis=1))
        at, radii, longest = [], [], []
        todo = [(np.arange(len(points)), 0, None)] if len(points) else []
        while todo:
            rows, center, parent = todo.pop()
            node = len(at)
            if parent is not None:
                self.children[parent].append(node)
            away = self._away(rows, center)
            at.append(center)
            radii.append(away.max())
            longest.append(self.sizes[rows].max())
            self.rows.append(rows)
            self.children.append([])
            if len(rows) > leaf and away.max() > 0:
                todo += [(part, first, node) for part, first in self._parted(rows, center, away)]
        self.at = np.array(at, dtype=np.int64)
        self.centers, self.center_sizes = points[self.at], self.sizes[self.at]
        self.radii, self.longest = np.array(radii), np.array(longest)
        self.children = [np.array(c, dtype=np.int64) for c in self.children]

    def _away(self, rows, center):
        return np.sqrt(((self.points[rows] - self.points[center]) ** 2).sum(axis=1))

    def _parted(self, rows, center, away):
        owner, nearest, centers = np.zeros(len(rows), dtype=np.int64), away, [center]
        while len(centers) < FAN_OUT and nearest.max() > 0:
            center = rows[int(nearest.argmax())]
            gap = self._away(rows, center)
            closer = gap < nearest
            owner[closer], nearest = len(centers), np.where(closer, gap, nearest)
            centers.append(center)
        return [(rows[owner == i], c) for i, c in enumerate(centers)]


class Search:
    """Top ``k`` of ``data`` for each of ``queries`` by integer inner product."""

    def __init__(self, queries, query_ids, data, data_ids, k):
        self.k, self.query_ids, self.data_ids = k, query_ids, data_ids
        biggest = float(max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0)))
        # Products and sums of floats are exact below 2**53; beyond, Python's integers.
        kind = np.float64 if biggest**2 * max(1, queries.shape[1]) < 2**53 else object
        self.queries, self.data = queries.astype(kind), data.astype(kind)
        self.asking = CoverTree(queries.astype(np.float64))
        self.tree = CoverTree(data.astype(np.float64))
        self.scores = [np.empty(0, np.int64) for _ in range(len(queries))]
        self.found = [np.empty(0, np.int64) for _ in range(len(queries))]
        self.worst = np.full(len(queries), -np.inf)

    def run(self) -> None:
        if len(self.queries) and len(self.data):
            self._meet(0, np.array([0]))

    def _bounds(self, node: int, others: np.ndarray) -> np.ndarray:
        """The largest inner product that the balls allow, with room for rounding.

        Two bounds: by the centers' product and both radii, and by the least distance and
        the longest vectors.
        """
        a, b = self.asking, self.tree
        radius, size = a.radii[node], a.center_sizes[node]
        product = b.centers[others] @ a.centers[node]
        radii, sizes = b.radii[others], b.center_sizes[others]
        spread = product + radius * sizes + radii * size + radius * radii
        gap = np.sqrt(np.maximum(0, size**2 + sizes**2 - 2 * product)) - radius - radii
        apart = (a.longest[node] ** 2 + b.longest[others] ** 2 - np.maximum(0, gap) ** 2) / 2
        room = 1e-6 * (1 + (a.longest[node] + radius) * (b.longest[others] + radii))
        return np.minimum(spread, apart) + room

    def _left(self, node: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Data nodes that can still matter to the node, most promising first, and bounds."""
        bounds = self._bounds(node, others)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= self.worst[self.asking.rows[node]].min()]
        return others[order], bounds[order]

    def _opened(self, others: np.ndarray, wider: float = -1.0) -> np.ndarray:
        """Each node wider than given by its children."""
        tree = self.tree
        return np.concatenate(
            [tree.children[o] if len(tree.children[o]) and tree.radii[o] > wider else [o] for o in others]
        ).astype(np.int64)

    def _meet(self, node: int, others: np.ndarray) -> None:
        others, _ = self._left(node, others)
        if not len(others):
            return
        children = self.asking.children[node]
        if len(children):
            # Open data nodes down to the width of the query node, then go down with both.
            others = self._opened(others, self.asking.radii[node])
            for child in children:
                self._meet(child, others)
            return
        while any(len(self.tree.children[o]) for o in others):
            others, _ = self._left(node, self._opened(others))
            if not len(others):
                return
        others, bounds = self._left(node, others)
        rows = self.asking.rows[node]
        for at in range(0, len(others), 8):
            if bounds[at] < self.worst[rows].min():
                return
            self._score(rows, np.concatenate([self.tree.rows[o] for o in others[at : at + 8]]))

    def _score(self, rows: np.ndarray, others: np.ndarray) -> None:
        scores = self.queries[rows] @ self.data[others].T
        hit = (scores >= self.worst[rows][:, None]) & (
            self.data_ids[others][None, :] != self.query_ids[rows][:, None]
        )
        for at in np.flatnonzero(hit.any(axis=1)):
            new = np.flatnonzero(hit[at])
            row = rows[at]
            exact = scores[at][new]
            if exact.dtype == object:
                exact = np.array([max(-_MAX, min(_MAX, int(s))) for s in exact])
            points = np.concatenate([self.scores[row], exact.astype(np.int64)])
            ids = np.concatenate([self.found[row], self.data_ids[others[new]]])
            best = np.lexsort((ids, -points))[: self.k]
            self.scores[row], self.found[row] = points[best], ids[best]
            if len(best) == self.k:
                self.worst[row] = points[best[-1]]


def _searched(group: pd.DataFrame, k: int) -> pd.DataFrame:
    """Top k of one pair of blocks."""
    asks = group["asks"].to_numpy(bool)
    vectors = np.stack(group["vector"].to_numpy()) if len(group) else np.empty((0, 0))
    ids = group["id"].to_numpy(np.int64)
    if not asks.any() or asks.all():
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
    search = Search(vectors[asks], ids[asks], vectors[~asks], ids[~asks], k)
    search.run()
    counts = [len(f) for f in search.found]
    return pd.DataFrame(
        {
            "query_id": np.repeat(search.query_ids, counts),
            "vec_id": np.concatenate(search.found),
            "score": np.concatenate(search.scores),
        }
    )


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) as longs; null where the vector can't take part."""
    usable = vector.isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(
    rows: DataFrame,
    asks: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    data_block: int = DATA_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every row where ``asks``.

    Scores are inner products of floor(scale * component); ties go to the smaller id. All
    rows but those with the query's own id are candidates, fewer than ``k`` give fewer.
    Ids must be whole numbers.

    A block pair holds at most about ``data_block`` and ``query_block`` rows, whatever
    vectors repeat; the stated queries meet all blocks of data.

    Defined cases: null ids, and vectors that are null or hold null or non-finite
    components, take no part; vectors meet only those of their own length; a repeated row
    is a result as often as it occurs, and a repeated query asks once; scores beyond 64
    bits are cut to them; an empty table gives an empty result.
    """
    usable = rows.select(
        quoted(id_col).cast("long").alias("id"),
        scaled(quoted(vector_col), scale).alias("vector"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).where("id is not null and vector is not null")
    size = F.size("vector").alias("dim")
    queries = usable.where("asks").dropDuplicates(["id"])
    n_data, n_queries = usable.count(), queries.count()
    data_blocks = max(1, -(-n_data // data_block))
    query_blocks = max(1, -(-n_queries // query_block))

    def dealt(frame: DataFrame, block: Column, own: str, other: str, n_other: int, asking: bool):
        return frame.select(
            size,
            block.alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
            "id",
            "vector",
            F.lit(asking).alias("asks"),
        )

    # Repeated rows differ in nothing but their place, so that takes part in the deal.
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(data_blocks)).cast("int")
    turn = F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")
    pairs = dealt(usable, place, "data_block", "query_block", query_blocks, False).unionByName(
        dealt(queries, turn, "query_block", "data_block", data_blocks, True)
    )
    found = shipped(pairs).groupBy("dim", "data_block", "query_block").applyInPandas(
        lambda group: _searched(group, k), "query_id long, vec_id long, score long"
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 20 == 0, 20)


ORACLE = """
WITH v AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
