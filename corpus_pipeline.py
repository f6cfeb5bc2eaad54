"""From raw documents to token ids: quality rules, near-duplicates, benchmark leaks, mixing, id files.

Every stage takes ``(spark, docs, sf_dir)``; the runner writes its rows as Parquet and reads them back as
the next stage's ``docs``. All stages but the last return the columns of ``documents``. Empty tables pass
through; rows without a ``doc_id`` are never grouped, matched or dropped by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstore.cluster import fresh, shared_dir
from rillstore.llm import decontam, idfile, minhash, mixing, quality
from rillstore.llm.queries import END_ID, TARGETS, table, tokenizer_path


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = fresh(docs, "gone")
    return docs.join(ids.select(F.col("doc_id").alias(gone)), docs["doc_id"] == F.col(gone), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and failing lines from the others."""
    good = quality.clean(docs)
    if "n_chars" in docs.columns:
        good = good.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return good.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id."""
    found = minhash.components(docs)
    kept = _without(docs, found.filter("not kept").select("doc_id").distinct())
    again = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if not again.isEmpty():  # rows of one id: the least stays
        rest = [c for c in docs.columns if c != "doc_id"]
        rows = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("r"))
        kept = _without(kept, again).unionByName(rows.select("doc_id", "r.*").select(*docs.columns))
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select("doc_id").distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that the languages' expected tokens meet the target shares; none goes."""
    return mixing.apply(docs, table(spark, sf_dir, "labels"), TARGETS, mixing.Mix(least=1.0), tokenizer_path())


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The id files' own account of every document row, in ascending order of id."""
    path = shared_dir(spark)
    idfile.write_ids(docs, path, tokenizer_path(), END_ID)
    return idfile.read_ids(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]

#: SQL cannot express sketches, the fitted mix or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``; what lies between goes to the shared folder."""
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{path}/{i}-{name}")
            docs = spark.read.parquet(f"{path}/{i}-{name}")
    return docs
