"""Substring search through posting lists beside a plain scan."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from stopscan.operators import text_index as tix
from stopscan.operators import variants as var

ALPHABET = "abAB é𝄞"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(0, 12))) for _ in range(3000)]
    texts += [None, "", "ab", "x" * 50_000 + "needle", "NEEDLE in hay", "needle"] + ["ab" * 9] * 50
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn(
        "other", F.when(F.col("id") % 7 == 0, "Bé")).repartition(6, "id")


def test_matches_equal_a_scan(spark, table):
    index = tix.build_index(table, ["text", "other"])
    hay = tix.haystack(["text", "other"])
    for query in ("needle", "ab", "", "  ABA ", "é𝄞a", "𝄞", "bab b", "a bé", "absent words", "ababab"):
        wanted = table.where(F.contains(hay, F.lit(query.strip().lower())))
        found = tix.matches(spark, index, query)
        assert found.columns == table.columns
        assert sorted(r.id for r in found.select("id").collect()) == sorted(
            r.id for r in wanted.select("id").collect()), query


def test_shown_rows_and_total_equal_the_scan(spark, table, rows):
    index = tix.build_index(table, ["text"])
    assert rows(tix.indexed_search(spark, index, "aba", "id")) == rows(
        var.search(table, "aba", ["text"], "id"))


def test_lists_stay_in_their_block_and_a_rare_query_leaves_few_rows(spark, table):
    index = tix.build_index(table, ["text"])
    lists = spark.read.parquet(index.postings)
    assert lists.agg(F.max(F.size("places"))).first()[0] <= tix.BLOCK_ROWS
    assert lists.groupBy("trigram", "_block").count().where("count > 1").isEmpty()
    assert tix.candidates(spark, index, "needle").count() == 3


def test_a_search_reads_only_the_blocks_that_may_match(spark, tmp_path):
    table = spark.range(0, 40 * tix.BLOCK_ROWS, 1, 1).select(
        "id", F.when(F.col("id") == 30_000, "one needle").otherwise("plain hay").alias("text"))
    index = tix.build_index(table, ["text"])
    found = tix.matches(spark, index, "needle")
    assert [r.id for r in found.collect()] == [30_000]
    # The scan's own filter names one block, so pages of all others are skipped.
    block = 30_000 // tix.BLOCK_ROWS
    assert spark.read.parquet(index.rows).where(F.col("_block") == block).count() == tix.BLOCK_ROWS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(_block,{block})" in plan or f"In(_block, [{block}])" in plan


def test_lists_are_made_where_the_rows_are_and_joined_across_pieces(spark, table, monkeypatch):
    rows = [(i // 4, i % 4, t) for i, t in enumerate(["abcab", "", "é𝄞a", "bcabx" * 40, "ab", "abc"])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))],
        names=["_block", "_place", "text"])
    wanted = {}
    for block, place, text in rows:
        for i in range(len(text) - 2):
            wanted.setdefault((text[i:i + 3], block), set()).add(place)
    for piece, letters in ((1 << 21, 200_000), (4, 200_000), (1 << 21, 4)):
        monkeypatch.setattr(tix, "PIECE", piece)
        monkeypatch.setattr(tix, "MOST_LETTERS", letters)
        found = {}
        for told in tix.listed(iter([batch.slice(0, 3), batch.slice(3)])):
            for r in told.to_pylist():
                found.setdefault((r["trigram"], r["_block"]), set()).update(r["places"])
        assert found == wanted


def test_single_trigrams_are_not_shuffled(spark, monkeypatch):
    many = spark.range(0, 2048, 1, 2).select("id", F.lit("the same words").alias("text"))
    shuffled = []
    whole = DataFrame.repartitionByRange

    def noted(df, *keys):
        shuffled.append(df.count())
        return whole(df, *keys)

    monkeypatch.setattr(DataFrame, "repartitionByRange", noted)
    index = tix.build_index(many, ["text"])
    assert shuffled == [24]
    assert tix.matches(spark, index, "same").count() == 2048


def test_empty_table(spark, table):
    index = tix.build_index(table.limit(0), ["text"])
    assert tix.matches(spark, index, "needle").count() == 0
    assert tix.matches(spark, index, "n").count() == 0
