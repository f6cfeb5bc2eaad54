"""All queries of the library by name, with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillstore.plans import catalog, engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temp views of the tables a text names."""
    import re

    words = {w.lower() for w in re.findall(r"\w+", sql)}
    for t in TABLES:
        if t in words:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _sql(v) for k, v in catalog.SAME.items()}
    out |= {k: _sql(v[0]) for k, v in catalog.PAIRS.items()}
    return out | engine.QUERIES


def oracle_sql() -> dict[str, str]:
    return catalog.SAME | {k: v[1] for k, v in catalog.PAIRS.items()} | engine.ORACLE
