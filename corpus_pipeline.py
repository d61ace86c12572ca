"""A training-corpus pipeline: toxicity, language ID, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of ``documents``,
whatever they are called, in whole rows. An empty table passes through every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftmill.llm import decontam, langid, packing, simhash, toxicity
from driftmill.llm.queries import pack_digest, pack_pieces, table
from driftmill.llm.storage import fresh_path
from driftmill.ship import ship

#: Rows that Python workers get at once at most. A row is a whole text: Spark's 10 000 of them, once in
#: the JVM and twice in each worker, take some 400 MB of an executor.
ARROW_ROWS = 1000
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and bound their batches for this session; a lower setting stays."""
    ship(spark)
    now = int(spark.conf.get(_ARROW_SETTING))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(_ARROW_SETTING, str(ARROW_ROWS))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among ``docs``, doesn't reject.

    Null and empty texts have no sign of toxicity and stay; repeated rows fare alike; without labels all stay.
    """
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified by an accepted margin.

    Null and empty texts and those without a letter have no language and go; repeated rows fare alike.
    """
    prepare(spark)
    return langid.keep_known(docs, langid.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles of similarity 0.8 or more, exactly.

    That of the least id stays, null ids last; of repeated rows one; texts without words are one class.
    """
    prepare(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows fare alike."""
    prepare(spark)
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of the documents that are left, written in a folder for each length, and a row for each of them.

    A null or empty text is a sequence of the end id alone; repeated rows are packed each. The ids are
    in the folder, the rows returned tell where a sequence belongs and its checksum.
    """
    prepare(spark)
    return pack_digest(packing.write_buckets(pack_pieces(docs), fresh_path(spark, "sequences")))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: models, shingles with XXH64 and tokenizers are beyond it; tests compare with brute force.
ORACLE_SQL = None
