"""Mixing sources to target weights: budgets down a tree, then a token prefix per leaf.

Weights go down the tree domain, language, source. A branch that can't fill its share
leaves the rest to its siblings, and only what all of them can't take goes up to the
ancestors' siblings. Each leaf then gives whole epochs and a prefix of one more, in an
order seeded per epoch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import WORD, documents, quoted, stored, without

#: Of the order key, hex digits that name a bucket: 65,536 buckets per leaf and epoch.
BUCKET_DIGITS = 4

_EXACT = "decimal(38,0)"
_NODES = ["_mx_0", "_mx_1", "_mx_2"]
_TOKENS = "_mx_tokens"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))


def _weight(node: Column, weights: Mapping[str, int]) -> Column:
    """Weight of a node's name; 1 where none is given."""
    chosen = F.lit(1)
    for name, weight in weights.items():
        chosen = F.when(node == name, F.lit(int(weight))).otherwise(chosen)
    return chosen.cast(_EXACT)


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight``, up to ``cap``.

    Children in order of cap to weight: those that the level of the rest would overfill
    get their cap; the others share what is left in proportion. Whole tokens that
    rounding leaves go one each to the first of them. All in whole numbers.
    """
    order = [F.expr("cast(cap as double) / cast(weight as double)"), F.col(name)]
    own = W.partitionBy(*parents)
    before = own.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = own.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    exact = lambda c: F.coalesce(c, F.lit(0)).cast(_EXACT)
    nodes = nodes.where("weight > 0").withColumns(
        {"_before": exact(F.sum("cap").over(before)), "_after": exact(F.sum("weight").over(after))}
    )
    nodes = nodes.withColumn("_full", F.expr("cap * _after <= weight * (budget - _before)"))
    nodes = nodes.withColumns(
        {
            "_rest": exact(F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(own), F.lit(0))),
            "_open": exact(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(own)),
        }
    )
    nodes = nodes.withColumn(
        "_got", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(weight * _rest) div _open")).cast(_EXACT)
    )
    share = own.orderBy(F.col("_full"), *order)
    nodes = nodes.withColumns(
        {
            "_left": exact(F.col("_rest") - F.sum(F.when(~F.col("_full"), F.col("_got")).otherwise(0)).over(own)),
            "_rank": F.row_number().over(share),
        }
    )
    return nodes.withColumn(
        "_got", (F.col("_got") + F.when(~F.col("_full") & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)).cast(_EXACT)
    )


def leaf_budgets(
    leaves: DataFrame, weights: Sequence[Mapping[str, int]], share: tuple[int, int], max_epochs: int
) -> DataFrame:
    """Token budget of every leaf, from the leaves' token counts.

    ``leaves``: the three node names and ``total``. The target is ``share`` (numerator and
    denominator) of the tokens on open paths; a leaf can give its tokens ``max_epochs``
    times. A weight of 0 anywhere on its path closes a leaf: it neither counts nor gives.
    """
    is_open = F.lit(True)
    for name, level in zip(_NODES, weights, strict=True):
        is_open = is_open & (_weight(F.col(name), level) > 0)
    caps = leaves.where(is_open).withColumn("leaf_cap", (F.col("total") * max_epochs).cast(_EXACT))
    # One number: what the root may give.
    target = F.expr(f"cast(least(sum(total) * {share[0]} div {share[1]}, sum(leaf_cap)) as {_EXACT})")
    whole = F.lit(str(caps.agg(target).first()[0] or 0)).cast(_EXACT)
    budgets, parents = None, []
    for depth, name in enumerate(_NODES):
        path = _NODES[: depth + 1]
        nodes = (
            caps.groupBy(*path)
            .agg(F.sum("leaf_cap").cast(_EXACT).alias("cap"))
            .withColumn("weight", _weight(F.col(name), weights[depth]))
        )
        nodes = nodes.join(budgets, parents) if parents else nodes.withColumn("budget", whole)
        budgets = _fill(nodes, parents, name).select(*path, F.col("_got").alias("budget"))
        parents = path
    return leaves.join(budgets, _NODES, "left").select(
        *_NODES, "total", F.coalesce("budget", F.lit(0)).cast("long").alias("budget")
    )


def mix_sources(
    docs: DataFrame,
    path: Sequence[Column],
    weights: Sequence[Mapping[str, int]],
    share: tuple[int, int] = (3, 5),
    max_epochs: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` as drawn, once per epoch, with ``epoch``, ``n_tokens``, ``taken``.

    ``path`` names domain, language and source; ``weights`` has one mapping per level, and
    a name without an entry weighs 1. A leaf with budget b and T tokens gives b div T
    whole epochs; the rest is the prefix of the next epoch's order. ``taken`` is less than
    ``n_tokens`` for the row that crosses the budget.

    The order is that of md5(seed:epoch:id). Buckets of that key are summed up per leaf;
    only rows of the one bucket where the prefix ends are ordered against each other, so
    no leaf has to fit into a task.

    Defined cases: null names are a branch named ''; null texts have no tokens; a leaf
    without tokens gives nothing; rows with equal ids are ordered by their token count;
    an empty table gives an empty result; a weight of 0 closes a branch, whose tokens don't
    count towards the target either; a text longer than its leaf's budget is taken in part,
    as only its number of tokens matters. Columns of ``docs`` named like a result column are
    replaced.
    """
    spark = docs.sparkSession
    names = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(path, _NODES, strict=True)]
    docs = without(docs, ["epoch", "n_tokens", "taken"])
    tokens = word_count(quoted(text_col)).cast("long")
    rows = docs.select(*[quoted(c) for c in docs.columns], *names, tokens.alias(_TOKENS))
    narrow = stored(docs.select(quoted(id_col).alias("_mx_id"), *names, tokens.alias(_TOKENS)))
    leaves = stored(narrow.groupBy(*_NODES).agg(F.sum(_TOKENS).alias("total")))
    plan = leaf_budgets(leaves, weights, share, max_epochs).where("budget > 0")
    # One row per leaf of the tree, so one file: its size tells Spark that it is small.
    plan = stored(
        plan.withColumns(
            {"_mx_whole": F.expr("budget div total"), "_mx_rest": F.expr("budget % total")}
        ).coalesce(1)
    )

    def keyed(frame: DataFrame, key: Column) -> DataFrame:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("_mx_whole").cast("string"), F.coalesce(key.cast("string"), F.lit("null")))
        return frame.withColumn("_mx_key", F.md5(text)).withColumn(
            "_mx_bucket", F.conv(F.substring("_mx_key", 1, BUCKET_DIGITS), 16, 10).cast("int")
        )

    sums = (
        keyed(narrow.join(plan, _NODES), F.col("_mx_id"))
        .groupBy(*_NODES, "_mx_rest", "_mx_bucket")
        .agg(F.sum(_TOKENS).alias("_sum"))
        .withColumn("_to", F.sum("_sum").over(W.partitionBy(*_NODES).orderBy("_mx_bucket")))
    )
    cuts = stored(
        sums.where("_to >= _mx_rest and _mx_rest > 0")
        .groupBy(*_NODES)
        .agg(F.min(F.struct("_mx_bucket", (F.col("_to") - F.col("_sum")).alias("start"))).alias("_mx_cut"))
        .join(plan, _NODES, "right")
        .coalesce(1)
    )
    drawn = keyed(rows.join(cuts, _NODES), quoted(id_col))
    order = [F.col("_mx_key"), F.col("_mx_sort"), F.col(_TOKENS)]
    below = W.partitionBy(*_NODES).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    edge = (
        drawn.where(F.col("_mx_bucket") == F.col("_mx_cut._mx_bucket"))
        .withColumn("_mx_sort", quoted(id_col))
        .withColumn("_mx_room", F.col("_mx_rest") - F.col("_mx_cut.start") - F.coalesce(F.sum(_TOKENS).over(below), F.lit(0)))
        .withColumn("_mx_part", F.when(F.col("_mx_room") > 0, F.least(F.col("_mx_room"), F.col(_TOKENS))))
    )
    plain = drawn.where(
        F.col("_mx_cut").isNull() | (F.col("_mx_bucket") != F.col("_mx_cut._mx_bucket"))
    ).withColumn("_mx_part", F.when(F.col("_mx_bucket") < F.col("_mx_cut._mx_bucket"), F.col(_TOKENS)))
    kept = [quoted(c) for c in docs.columns]
    both = plain.select(*kept, "_mx_whole", _TOKENS, "_mx_part").union(
        edge.select(*kept, "_mx_whole", _TOKENS, "_mx_part")
    )
    takes = F.concat(
        F.transform(
            F.expr("if(_mx_whole > 0, sequence(0L, _mx_whole - 1), cast(array() as array<bigint>))"),
            lambda e: F.struct(e.alias("epoch"), F.col(_TOKENS).alias("taken")),
        ),
        F.when(
            F.col("_mx_part").isNotNull(),
            F.array(F.struct(F.col("_mx_whole").alias("epoch"), F.col("_mx_part").alias("taken"))),
        ).otherwise(F.expr("cast(array() as array<struct<epoch:bigint,taken:bigint>>)")),
    )
    return both.withColumn("_mx_take", F.explode(takes)).select(
        *kept,
        F.col("_mx_take.epoch").cast("long").alias("epoch"),
        F.col(_TOKENS).alias("n_tokens"),
        F.col("_mx_take.taken").cast("long").alias("taken"),
    )


#: Production weights by level: domain, language, source.
WEIGHTS = (
    {"curated": 4, "web": 6},
    {"de": 2, "en": 5, "es": 1, "fr": 2},
    {"src0": 3},
)
SHARE, MAX_EPOCHS, SEED = (3, 5), 2, 7


def domain(source: Column) -> Column:
    """The domain of a source: sources numbered 10 and up are curated, all others web."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src([0-9]{1,9})$", 1)
    return F.when((number != "") & (number.cast("int") >= 10), "curated").otherwise("web")


def standard_path() -> list[Column]:
    return [domain(F.col("source")), F.col("lang"), F.col("source")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("domain", domain(F.col("source")))
    return mix_sources(docs, standard_path(), WEIGHTS, SHARE, MAX_EPOCHS, SEED).drop("text")


def _level_sql(depth: int) -> str:
    """One level of the tree as SQL, from table b{depth} to b{depth + 1}."""
    names = ["n0", "n1", "n2"][: depth + 1]
    name, path = names[-1], ", ".join(names)
    parent = ", ".join(names[:-1]) or "1"
    same = " AND ".join(f"c.{n} = b.{n}" for n in names[:-1]) or "true"
    cases = " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in WEIGHTS[depth].items())
    order = f"cap::DOUBLE / weight::DOUBLE, {name}"
    return f"""
c{depth} AS (SELECT {path}, sum(leaf_cap)::HUGEINT AS cap,
    (CASE {cases} ELSE 1 END)::HUGEINT AS weight FROM leaf GROUP BY {path}),
d{depth} AS (SELECT c.*, b.budget,
    coalesce(sum(cap) OVER (PARTITION BY {", ".join("c." + n for n in names[:-1]) or "1"} ORDER BY cap::DOUBLE / weight::DOUBLE, c.{name}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS cap_before,
    sum(weight) OVER (PARTITION BY {", ".join("c." + n for n in names[:-1]) or "1"} ORDER BY cap::DOUBLE / weight::DOUBLE, c.{name}
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weight_after
    FROM c{depth} c JOIN b{depth} b ON {same}),
e{depth} AS (SELECT *, cap * weight_after <= weight * (budget - cap_before) AS full_up FROM d{depth}),
f{depth} AS (SELECT *,
    (budget - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (PARTITION BY {parent}), 0))::HUGEINT AS rest,
    coalesce(sum(CASE WHEN NOT full_up THEN weight END) OVER (PARTITION BY {parent}), 0)::HUGEINT AS open_weight
    FROM e{depth}),
g{depth} AS (SELECT *, CASE WHEN full_up THEN cap ELSE (weight * rest) // open_weight END AS got FROM f{depth}),
h{depth} AS (SELECT *,
    rest - sum(CASE WHEN full_up THEN 0 ELSE got END) OVER (PARTITION BY {parent}) AS spare,
    row_number() OVER (PARTITION BY {parent} ORDER BY full_up, {order}) AS place FROM g{depth}),
b{depth + 1} AS (SELECT {path},
    (got + CASE WHEN NOT full_up AND place <= spare THEN 1 ELSE 0 END)::HUGEINT AS budget FROM h{depth})"""


ORACLE = f"""
WITH docs AS (
    SELECT doc_id, lang, source,
           CASE WHEN regexp_full_match(coalesce(source, ''), 'src[0-9]{{1,9}}')
                 AND substr(source, 4)::INT >= 10 THEN 'curated' ELSE 'web' END AS domain,
           coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
    FROM documents),
rows0 AS (SELECT *, domain AS n0, coalesce(lang, '') AS n1, coalesce(source, '') AS n2 FROM docs),
leaf AS (SELECT n0, n1, n2, sum(n_tokens)::HUGEINT AS total, sum(n_tokens)::HUGEINT * {MAX_EPOCHS} AS leaf_cap
         FROM rows0 GROUP BY n0, n1, n2),
b0 AS (SELECT least(sum(total) * {SHARE[0]} // {SHARE[1]}, sum(leaf_cap))::HUGEINT AS budget FROM leaf),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
plan AS (SELECT n0, n1, n2, budget // total AS whole, budget % total AS rest
         FROM leaf JOIN b3 USING (n0, n1, n2) WHERE budget > 0),
keyed AS (SELECT r.*, p.whole, p.rest,
          md5('{SEED}:' || p.whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS k
          FROM rows0 r JOIN plan p USING (n0, n1, n2)),
run AS (SELECT *, rest - coalesce(sum(n_tokens) OVER (PARTITION BY n0, n1, n2 ORDER BY k, doc_id, n_tokens
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM keyed)
SELECT doc_id, lang, source, domain, whole::BIGINT AS epoch, n_tokens,
       least(room, n_tokens)::BIGINT AS taken FROM run WHERE rest > 0 AND room > 0
UNION ALL
SELECT doc_id, lang, source, domain, unnest(range(whole::BIGINT)) AS epoch, n_tokens, n_tokens AS taken
FROM keyed WHERE whole > 0
"""
