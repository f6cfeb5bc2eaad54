"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillstore.cluster import shared_dir
from rillstore.llm import chat, oracles, quality

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Target shares of the domains' tokens.
TARGETS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import minhash

    return minhash.components(table(spark, sf_dir, "documents"), minhash.Near(k=4))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import quality

    return quality.judge(table(spark, sf_dir, "documents")).select(*quality.RESULT)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import repeats

    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import pages

    return pages.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS, tokenizer=tokenizer_path())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import chat

    return chat.views(table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import tokens

    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import idfile

    path = shared_dir(spark)
    idfile.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return idfile.read_ids(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillstore.llm import decontam

    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_repeats": op4_repeats,
    "op5_main_text": op5_main_text,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_token_counts": op8_token_counts,
    "op9_token_ids": op9_token_ids,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": oracles.NEAR,
    "op2_quality": quality.ORACLE,
    "op4_repeats": oracles.REPEATS,
    "op5_main_text": oracles.PAGES,
    "op7_chat": chat.ORACLE,
    "op10_decontamination": oracles.DECONTAMINATION,
}
