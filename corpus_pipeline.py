"""From raw documents to token ids: the stages of a training corpus, one after the other.

Each stage works on all that the one before it kept, and gives documents with their own
columns; the last one gives their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from llm.common import documents, quoted, stored

#: Part of the tokens that the mix takes, each document once at most.
SHARE, EPOCHS = (4, 5), 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labelled rows doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    lexicon = toxicity.learn(toxicity.training_rows(docs.select("doc_id", "text"), labels))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.where("predicted = 0").select(*[quoted(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar word shingles hold together."""
    return jaccard_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one that crosses a budget stays whole."""
    drawn = mixing.mix_sources(docs, mixing.standard_path(), mixing.WEIGHTS, SHARE, EPOCHS, mixing.SEED)
    return drawn.select(*[quoted(c) for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, and their number."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("BPE", tokenise),
]

#: SQL can express neither what the first stage learns nor the last one's merges; the tests
#: hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
