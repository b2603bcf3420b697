"""The corpus pipeline: five stages over ``documents``, each stored as Parquet for the next.

Documents predicted toxic go; of each class of near duplicates one document stays; documents
that benchmark passages contaminate go; the rest is mixed to target weights (a document appears
as often as the mix takes it, in training order); every row gets a shard.  All stages but the
last return the columns of ``documents``; the last adds ``shard``.

Defined cases: null, empty and wordless texts pass the first three stages (toxic only where the base
rate is, in no class but their own, contaminated by nothing) and count no words in the mix, which takes
them as its passes reach them; rows with a null ``doc_id`` are never anyone's duplicate; a null source is
a source of its own; repeated rows leave one row, and of a class its smallest ``doc_id`` stays; further columns,
whatever their names, are carried along; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from caremart.llm.common import cut, table

# SQL can't express the neighbour votes and sampled paths; tests hold run() against brute force.
ORACLE_SQL = None


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_open(docs, table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(docs, model, docs.columns).filter("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return _unpacked(found.filter("NOT contaminated"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(mixing.training_order(mixing.mix(docs, docs.columns)), docs.columns)


def place_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
