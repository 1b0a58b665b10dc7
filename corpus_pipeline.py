"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that ``run`` writes as Parquet
and rereads as the next stage's ``docs``.  All but the last return the columns of their input.

Rows whose ``doc_id`` is null, and rows that share one, are documents of their own in every stage.  Null, empty and letterless texts leave at language ID, as undetermined.
Extra columns travel with their rows up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runready.llm.bayes_minhash import near_duplicate_groups, row_key
from runready.llm.catalog import split_by_id, word_tokenizer
from runready.llm.language_id import predict, train
from runready.llm.spaced_seeds import contaminated
from runready.llm.tables import read_table, shielded, stored
from runready.llm.temperature_mix import mix
from runready.llm.token_store import tokenize_documents

MAX_REPETITION = 2.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: those that the model rejects go.

    The model learns from the labelled documents that are not held out; ``lang`` keeps its value.
    """
    labelled = split_by_id(docs.select("doc_id", "text", "lang"))
    model = train(labelled.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang"))
    rows, restored = shielded(docs, "text")
    return predict(rows, model, *rows.columns).where("not rejected").select(*restored)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on 5-word shingles at similarity 0.8: one with the smallest id.

    Rows that share an id, or have none, are documents of their own; of rows equal in id and text one stays.
    """
    groups = stored(near_duplicate_groups(docs, shingle=5, threshold=0.8).where("n_shingles > 0").select("row_key", "first"), "groups")
    later = stored(groups.where("row_key <> first").select("row_key").distinct(), "later-copies")
    repeated = stored(groups.groupBy("row_key").count().where("count > 1").select("row_key"), "repeated-rows")
    rows, restored = shielded(docs, "doc_id", "text")
    rows = rows.withColumn("row_key", row_key()).join(later, "row_key", "left_anti")
    once = rows.join(repeated, "row_key", "left_anti")
    one_of = rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])
    return once.unionByName(one_of).select(*restored)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows that share an id, or have none, are judged each for itself."""
    rows, restored = shielded(docs, "doc_id", "text")
    rows = rows.withColumn("row_key", row_key())
    found = contaminated(rows.select(F.col("row_key").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    hits = stored(found.select(F.col("doc_id").alias("row_key")).distinct(), "leaks")
    return rows.join(hits, "row_key", "left_anti").select(*restored)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources flattened as far as no source is repeated more than ``MAX_REPETITION`` times and every
    document stays once at least; a repeated document has a row for each copy."""
    rows, restored = shielded(docs, "doc_id", "text", "source")
    return mix(rows, budget=None, max_repetition=MAX_REPETITION).select(*restored)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in ascending ``doc_id``: ``doc_id, start, n_tokens, ids_crc32`` read back from them."""
    return tokenize_documents(docs, word_tokenizer(), end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

# Language ID and token output have no SQL form: the rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the ``documents`` of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
