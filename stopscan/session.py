"""Session settings, lineage cuts and size checks shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stopscan", cores: str | int = "*", partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's settings win."""

    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Cells and bootstrap buckets are read in bounded groups, so Arrow batches stay small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    )
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only where driver and executors are one process may it be unset: a scratch folder then stands
    in for it. On a cluster such a folder would exist on one machine alone, so it is an error.
    """

    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = getattr(spark, "_stopscan_scratch", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
        spark._stopscan_scratch = fallback
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for a table one job writes and another reads."""

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table under the shared folder once nothing reads it any more."""

    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, *columns: str, name: str = "cut") -> DataFrame:
    """Write `df` (or only `columns`) as Parquet in the shared folder and read it back.

    Used where several passes read one derived table or a result must not be computed twice (an
    approximate sketch, a loop's state): a lost executor then re-reads files instead of deriving a
    different answer, and later scans see column statistics and read only what they need.
    """

    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.select(*columns) if columns else df).write.parquet(path)
    return spark.read.parquet(path)


def refuse(findings: DataFrame, reason: str, shown: int = 20) -> None:
    """Raise an error if `findings` has any row; its message names the first `shown` of them."""

    found = findings.limit(shown).collect()
    if found:
        named = "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in found)
        raise ValueError(f"{reason}: {named}")


def within(df: DataFrame, rows: int) -> bool:
    """Whether `df` holds at most `rows` rows, reading no more than it must to know."""

    return df.limit(rows + 1).count() <= rows
