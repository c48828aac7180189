"""Resumable append: compute only the keys a table does not hold yet.

An interrupted run is repeated with the same arguments; what was written stays and is not computed
again, so the table ends up the same however often the run was cut short. Every append is a batch with
an id of its own. Two runs that overlap in time may both compute a key; its rows are those of the
batch with the smaller id, whoever reads and however often, so no key is ever there twice.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch_id"
#: What Spark reports of a path that no run has committed to; any other error is one.
UNWRITTEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows at `path` with their batch, or nothing where no run has written yet."""

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in UNWRITTEN:
            return None
        raise


def written(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The table at `path`, each key from the first batch that holds it."""

    found = batches(spark, path)
    if found is None:
        return None
    first = found.groupBy(*keys).agg(F.min(BATCH).alias(BATCH))
    return found.join(first, [*keys, BATCH], "left_semi").drop(BATCH)


def pending(wanted: DataFrame, done: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The keys asked for that are not written."""

    asked = wanted.select(*keys).distinct()
    if done is None:
        return asked
    return asked.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resume(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str],
           compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append `compute(pending keys)` to the table at `path` and return its rows of `wanted`.

    Keys are not null. A batch's id starts with the time it was begun and ends at random.
    """

    left = pending(wanted, batches(spark, path), keys)
    if not left.isEmpty():
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        compute(left).withColumn(BATCH, F.lit(name)).write.mode("append").parquet(path)
    found = written(spark, path, keys)
    return found.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def index_range(spark: SparkSession, families: Sequence[str], permutations: int,
                offset: int = 0) -> DataFrame:
    """`(shuffle, permutation)` for a contiguous range of indices; shards take disjoint ranges."""

    return spark.range(offset, offset + permutations).select(
        F.explode(F.lit(list(families))).alias("shuffle"), F.col("id").alias("permutation"))
