"""Substring search through trigram posting lists that are written once and read many times.

Rows are numbered as they are written and belong to blocks of `BLOCK_ROWS` consecutive numbers. A
posting list holds, for one trigram of the lower-cased text and one block, the places in the block
whose text has it, so no list is longer than a block however common its trigram is. Lists lie in
files sorted by trigram and block: a search reads only the pages of its own trigrams, intersects
their lists block by block, and reads only the blocks left over, where `contains` decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopscan.session import drop_path, scratch_path

BLOCK_ROWS = 1024
#: Characters whose trigrams are listed at once.
PIECE = 1 << 21
#: So many different letters to the third, times the rows of a block, are numbers of 63 bits.
MOST_LETTERS = 200_000
#: Up to so many blocks are named in the filter of the scan; more are joined.
NAMED_BLOCKS = 1000


@dataclass(frozen=True)
class TextIndex:
    """Where the numbered rows and their posting lists are, and which columns are searched."""

    rows: str
    postings: str
    fields: tuple[str, ...]


def haystack(fields: tuple[str, ...] | list[str]) -> Column:
    """The searched text: the fields in lower case, a missing one empty, joined by spaces."""

    return F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def posting_lists(texts: list[str], places: list[int]) -> Iterator[
        tuple[list[str], np.ndarray, np.ndarray]]:
    """Trigrams of some texts of one block, where the list of each ends, and the places in them.

    A trigram and a place are one number, so one sort gives every list. More texts or letters than
    that holds are taken in halves; the two halves of a long text share two characters.
    """

    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(sys.maxunicode + 1, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    if len(codes) > 2 * PIECE or len(alphabet) > MOST_LETTERS:
        half = len(texts) // 2
        if half:
            yield from posting_lists(texts[:half], places[:half])
            yield from posting_lists(texts[half:], places[half:])
        else:
            middle = len(codes) // 2
            yield from posting_lists([texts[0][:middle + 2]], places)
            yield from posting_lists([texts[0][middle:]], places)
        return
    if len(codes) < 3:
        return
    base = len(alphabet)
    letters = (np.cumsum(seen) - 1)[codes]
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[:-2] == owner[2:]
    named = (letters[:-2] * base + letters[1:-1]) * base + letters[2:]
    found = np.unique(named[whole] * BLOCK_ROWS + np.array(places)[owner[:-2][whole]])
    names, place = found // BLOCK_ROWS, (found % BLOCK_ROWS).astype(np.int32)
    last = np.flatnonzero(np.append(np.diff(names) != 0, len(names) > 0))
    kept = names[last]
    spelled = np.stack([kept // base**2, kept // base % base, kept % base], axis=1)
    text = alphabet[spelled].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    yield [text[i:i + 3] for i in range(0, len(text), 3)], last + 1, place


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, _block, places) of (_block, _place, text), for each run of rows of one block."""

    texts: list[str] = []
    places: list[int] = []

    def told(block: int) -> Iterator[pa.RecordBatch]:
        for grams, ends, place in posting_lists(texts, places):
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.string()), pa.array(np.full(len(grams), block, np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(place))],
                names=["trigram", "_block", "places"])
        texts.clear()
        places.clear()

    at, size = -1, 0
    for batch in batches:
        for block, place, text in zip(*[c.to_pylist() for c in batch.columns]):
            if texts and (block != at or size + len(text) > PIECE):
                yield from told(at)
                size = 0
            at, size = block, size + len(text)
            texts.append(text)
            places.append(place)
    if texts:
        yield from told(at)


def build_index(table: DataFrame, fields: list[str], name: str = "search") -> TextIndex:
    """Number and write the rows, then write their posting lists, in the shared folder.

    Rows of a block lie together, so the task that reads them lists it, and lists are shuffled instead
    of single trigrams. They are written first, since a range shuffle reads its input twice.
    """

    spark = table.sparkSession
    index = TextIndex(scratch_path(spark, f"{name}-rows"), scratch_path(spark, f"{name}-postings"),
                      tuple(fields))
    number = F.monotonically_increasing_id()
    table.withColumn("_number", number).select(
        F.shiftright("_number", BLOCK_ROWS.bit_length() - 1).alias("_block"),
        F.col("_number").bitwiseAND(BLOCK_ROWS - 1).cast("int").alias("_place"),
        *table.columns).write.option("parquet.page.row.count.limit", BLOCK_ROWS).parquet(
        index.rows)
    path = scratch_path(spark, f"{name}-lists")
    spark.read.parquet(index.rows).select("_block", "_place", haystack(fields)).mapInArrow(
        listed, "trigram string, _block bigint, places array<int>").write.parquet(path)
    # The range shuffle brings equal (trigram, block) together, so the grouping adds none. A block cut
    # by a piece or a split has its lists of one trigram joined here.
    spark.read.parquet(path).repartitionByRange("trigram", "_block").groupBy(
        "trigram", "_block").agg(F.sort_array(F.array_distinct(F.flatten(
            F.collect_list("places")))).alias("places")).sortWithinPartitions(
        "trigram", "_block").write.option("parquet.page.row.count.limit", 4096).parquet(
        index.postings)
    drop_path(spark, path)
    return index


def candidates(spark: SparkSession, index: TextIndex, wanted: str) -> DataFrame:
    """(_block, _place) of the rows that have every trigram of `wanted`."""

    grams = sorted({wanted[i:i + 3] for i in range(len(wanted) - 2)})
    lists = spark.read.parquet(index.postings).where(F.col("trigram").isin(grams)).groupBy(
        "_block").agg(F.collect_list("places").alias("lists")).where(
        F.size("lists") == len(grams))
    return lists.select("_block", F.explode(F.aggregate(
        F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0)),
        lambda held, more: F.array_intersect(held, more))).alias("_place"))


def matches(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """Every row whose text contains `query`, whatever its case; a blank query matches every row.

    Queries under three characters have no trigram and scan the rows.
    """

    wanted = query.strip().lower()
    rows = spark.read.parquet(index.rows)
    holds = F.contains(haystack(index.fields), F.lit(wanted))
    if len(wanted) >= 3:
        left = candidates(spark, index, wanted)
        blocks = [r["_block"] for r in left.select("_block").distinct().limit(
            NAMED_BLOCKS + 1).collect()]
        if len(blocks) <= NAMED_BLOCKS:
            rows = rows.where(F.col("_block").isin(blocks))
        rows = rows.join(left, ["_block", "_place"], "left_semi")
    return rows.where(holds).drop("_block", "_place")


def indexed_search(spark: SparkSession, index: TextIndex, query: str, order: str,
                   shown: int = 12) -> DataFrame:
    """The first `shown` matches by `order`, each with the total number found."""

    found = matches(spark, index, query)
    total = found.agg(F.count(F.lit(1)).alias("total")).scalar()
    return found.orderBy(order).limit(shown).withColumn("total", total)
