"""Reading, settling, hot-key joins and connected components shared by the operators here."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopscan.session import drop_path, scratch_path

#: A table is broadcast only after its rows were counted, and only up to this many estimated bytes.
BROADCAST_BYTES = 64 << 20
#: A key is hot when it has over one in this many of all rows, so there are fewer hot keys than this.
HOT_KEYS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written once as Parquet in the shared folder, read back, and the path."""

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` marked for broadcast if `rows` counted rows fit the bound, else left to shuffle."""

    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column has at most `limit` bytes, or one row above it."""

    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def id_text(column: str = "doc_id") -> Column:
    """The id as text; a missing id is empty text."""

    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    return F.crc32(id_text(column)) % modulus == remainder


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int,
                  spread: Column) -> DataFrame:
    """Each of `rows` with the columns of its group, however many rows one group holds.

    `groups` has one row per `key` with its row count in `size`; `total` is the count of all rows.
    Fewer than HOT_KEYS keys can hold over 1/HOT_KEYS of the rows, so those are broadcast. Rows
    of a hot key are dealt out by `spread` in the shuffle that serves the rest, where they meet
    nothing.
    """

    floor = max(1000, total // HOT_KEYS)
    facts = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > floor).select(
        F.col(key).alias("__hot_key"), F.struct(*facts).alias("__hot"))
    cool = groups.where(F.col(size) <= floor).select(
        F.col(key).alias("__key"), F.lit(0).cast("bigint").alias("__lane"),
        F.struct(*facts).alias("__cool"))
    lane = F.when(F.col("__hot").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.xxhash64(spread).bitwiseOR(F.lit(1)))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn(
        "__own", lane)
    joined = marked.join(cool, (F.col(key) == F.col("__key"))
                         & (F.col("__own") == F.col("__lane")), "left")
    found = F.coalesce("__hot", "__cool")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in facts])


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart where ids repeat or are missing: the id and a hash of all columns.

    Keys sort by id, missing ids last. Rows of one key are the same in every column.
    """

    return F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"),
                    F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("mark"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents under their row keys, for operators that decide by doc_id."""

    return docs.select(row_key(docs).alias("doc_id"), "text")


def keep_rows(docs: DataFrame, dropped: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """`docs` without the rows whose keys are in the settled table `dropped`, column `key`.

    Of rows whose key is in the settled table `once`, one stays. Tables of keys are broadcast only
    after a count.
    """

    named = docs.withColumn("__row", row_key(docs))
    gone = dropped.select(F.col("key").alias("__gone")).distinct()
    left = named.join(if_small(gone, dropped.count(), 48), F.col("__row") == F.col("__gone"),
                      "left_anti")
    again = once.count() if once is not None else 0
    if again:
        single = if_small(once.select(F.col("key").alias("__once")).distinct(), again, 48)
        same = F.col("__row") == F.col("__once")
        # Equal rows: their repeats add up to one in every task before the shuffle.
        one = left.join(single, same, "left_semi").groupBy("__row").agg(
            *[F.first(f"`{c}`").alias(c) for c in docs.columns])
        left = left.join(single, same, "left_anti").select("__row", *docs.columns).unionByName(one)
    return left.select(*docs.columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Edges (a, b) are contracted by alternating large-star and small-star steps; each step is a
    grouped minimum and a join, and is written to the shared folder, so lineage does not grow and
    a lost executor re-reads files. It ends when a step changes no edge, for a graph of any shape.
    """

    spark = edges.sparkSession
    start = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = settle(start, name)
    mark = (-1, None)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = settle(large, name)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = (small.select(F.col("x").alias("a"), F.col("m").alias("b"))
                 .unionByName(small.select("a", F.col("m").alias("b")))
                 .where("a <> b").distinct())
        following, following_path = settle(small, name)
        drop_path(spark, path)
        drop_path(spark, large_path)
        current, path = following, following_path
        seen = current.agg(F.count(F.lit(1)), F.sum(
            F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (seen[0], seen[1]) == mark:
            break
        mark = (seen[0], seen[1])
    return current.groupBy("a").agg(F.min("b").alias("root")).select(
        F.col("a").alias("node"), "root").unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
