"""Exact order statistics of a whole column, without a task that holds all its values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstore.cluster import cut


def exact_percentile(df: DataFrame, column: str, p: float, name: str = "percentile") -> DataFrame:
    """One row: what ``percentile(column, p)`` gives (null without values).

    Distinct values are counted and dealt out by range; one number a range goes to the driver, and only the
    ranges that hold the two ranks around the percentile are read again.
    """
    spark = df.sparkSession
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    own = cut(counted.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")))
    sums = sorted(map(tuple, own.groupBy("part").agg(F.sum("n")).collect()))
    total = sum(n for _, n in sums)
    if not total:
        return spark.createDataFrame([(None,)], f"`{name}` double")
    at = p * (total - 1)
    values, before = {}, 0
    for part, n in sums:
        ranks = [r - before for r in {math.floor(at), math.ceil(at)} if before <= r < before + n]
        if ranks:
            upto = own.filter(F.col("part") == part).withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v")))
            for r in ranks:
                values[before + r] = upto.filter(F.col("upto") > r).agg(F.min("v")).first()[0]
        before += n
    low, high = values[math.floor(at)], values[math.ceil(at)]
    got = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return spark.createDataFrame([(got,)], f"`{name}` double")
