"""The corpus pipeline: documents through toxicity, exact and near deduplication, benchmark decontamination
and tokenisation. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.common import masked, recorded, removed, table, unmasked, written
from kinetrace.llm.decontamination import decontaminate
from kinetrace.llm.exact_dedup import one_of_equal
from kinetrace.llm.near_dedup import one_of_each
from kinetrace.llm.sentencepiece_bpe import token_digests
from kinetrace.llm.toxicity import THRESHOLD, scored, train, training_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; those without text stay."""
    model = train(training_rows(docs, table(spark, sf_dir, "labels")))
    plain, names = masked(docs)
    return unmasked(scored(plain, model, plain.columns, names["text"]).where(F.col("score") < THRESHOLD), names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    plain, names = masked(docs)
    plain = plain.toDF(*[c.strip("_") for c in plain.columns])
    return unmasked(one_of_equal(plain, names["doc_id"].strip("_"), names["text"].strip("_")), {c: n.strip("_") for c, n in names.items()})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    plain, names = masked(docs)
    tested = decontaminate(plain, table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], carry=tuple(plain.columns))
    return unmasked(tested.where("NOT contaminated"), names)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text decoded from them."""
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: SQL expresses neither the first stage nor the last; the tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves in the shared folder goes when its result is written, and a
    result when the next one is; the folder of another run is never touched."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        with recorded() as tables:
            docs = written(step(spark, docs, sf_dir), name)
        removed(spark, [*before, *tables[:-1]])
        before = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
