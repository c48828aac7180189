"""Exact duplicates through a cuckoo-filter index of live digests.

The index is cut into parts by the digest. Each part has stored keys (the content) and a cuckoo
filter over them: two candidate buckets of four 16-bit fingerprints per digest, each fingerprint
with the number of the stored key it stands for. A digest whose fingerprint is found is a *hit*,
and only the full stored digest decides whether it is a copy; one that is not found is new. Deletion
empties the verified slot. When an insertion finds no place after `KICKS` moves, the part's filter
doubles and is filled again from its stored keys.

Rows are pre-aggregated batch by batch before the shuffle, so a text that makes up a third of the
corpus reaches its part as one row per batch. Parts follow the number of rows, so a part stays
within a task's memory.

Defined results: a null text counts as empty, and texts are equal when their bytes are. Of equal
texts the row with the largest doc_id stays; repeated rows of that id are that row and stay with
it. Null ids lose to any id; among themselves they stay. An empty table gives an empty result, and
further columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import attach_groups, settle

KICKS = 500
PART_ROWS = 100_000


class CuckooFilter:
    """Fingerprints of digests (hexadecimal text), each naming the stored key it stands for."""

    def __init__(self, expected: int) -> None:
        self.buckets = 1 << max(4, (max(1, expected) * 10 // (4 * 9)).bit_length())
        self.keys: list[str | None] = []
        self._clear()

    def _clear(self) -> None:
        self.prints = [0] * (4 * self.buckets)
        self.owners = [-1] * (4 * self.buckets)

    def _places(self, digest: str) -> tuple[int, int, int]:
        mark = int(digest[-4:], 16) or 1
        one = int(digest[-12:-4], 16) & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, digest: str) -> int:
        """The number of the stored key equal to `digest`, or -1; a bare hit is not enough."""

        at = self._slot(digest)
        return -1 if at < 0 else self.owners[at]

    def _slot(self, digest: str) -> int:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for at in range(4 * bucket, 4 * bucket + 4):
                if self.prints[at] == mark and self.keys[self.owners[at]] == digest:
                    return at
        return -1

    def insert(self, digest: str) -> int:
        """Store a digest that is not there yet; its number."""

        self.keys.append(digest)
        number = len(self.keys) - 1
        if not self._put(digest, number):
            self._resize()
        return number

    def _put(self, digest: str, number: int) -> bool:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for at in range(4 * bucket, 4 * bucket + 4):
                if not self.prints[at]:
                    self.prints[at], self.owners[at] = mark, number
                    return True
        bucket = two
        for turn in range(KICKS):
            at = 4 * bucket + (turn + number) % 4
            mark, self.prints[at] = self.prints[at], mark
            number, self.owners[at] = self.owners[at], number
            bucket = self._other(bucket, mark)
            for free in range(4 * bucket, 4 * bucket + 4):
                if not self.prints[free]:
                    self.prints[free], self.owners[free] = mark, number
                    return True
        return False

    def _resize(self) -> None:
        filled = False
        while not filled:
            self.buckets *= 2
            self._clear()
            filled = all(self._put(k, n) for n, k in enumerate(self.keys) if k is not None)

    def delete(self, digest: str) -> bool:
        at = self._slot(digest)
        if at < 0:
            return False
        self.keys[self.owners[at]] = None
        self.prints[at], self.owners[at] = 0, -1
        return True


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row."""

    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias(
        "text_sha256"))


INDEX = "digest string, keep_id {kind}, group_size bigint"


def insertions(hashed: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): one row per digest, added up in every task before the shuffle,
    so a text that a third of all rows share reaches the index as one row."""

    return hashed.groupBy(F.col("text_sha256").alias("digest")).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def updated(stored: DataFrame | None, added: DataFrame, removed: DataFrame | None = None,
            parts: int = 8) -> DataFrame:
    """The index after `removed` digests are deleted and `added` ones inserted.

    `stored` and `added` are (digest, keep_id, group_size); an added digest that is live already
    raises its group's size and its largest id. `removed` is (digest).
    """

    kind = dict(added.dtypes)["keep_id"]
    tagged = [added.withColumn("act", F.lit(2))]
    if stored is not None:
        tagged.append(stored.withColumn("act", F.lit(0)))
    if removed is not None:
        tagged.append(removed.distinct().select(
            "digest", F.lit(None).cast(kind).alias("keep_id"),
            F.lit(0).cast("bigint").alias("group_size"), F.lit(1).alias("act")))
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)

    def run(table: pa.Table) -> pa.Table:
        """Ids stay Arrow values: as a column of floats, large ones beside a null would be rounded."""

        index = CuckooFilter(table.num_rows)
        best: list = []
        sizes: list[int] = []
        table = table.select(["digest", "keep_id", "group_size", "act"]).sort_by("act")
        for digest, keep, size, act in zip(*[c.to_pylist() for c in table.columns]):
            if act == 1:
                index.delete(digest)
                continue
            at = index.find(digest)
            if at < 0:
                index.insert(digest)
                best.append(keep)
                sizes.append(size)
            else:
                sizes[at] += size
                if keep is not None and (best[at] is None or keep > best[at]):
                    best[at] = keep
        live = [n for n, k in enumerate(index.keys) if k is not None]
        return pa.table({
            "digest": pa.array([index.keys[n] for n in live], pa.string()),
            "keep_id": pa.array([best[n] for n in live], table.schema.field("keep_id").type),
            "group_size": pa.array([sizes[n] for n in live], pa.int64())})

    part = F.pmod(F.xxhash64("digest"), F.lit(parts))
    return rows.groupBy(part.alias("part")).applyInArrow(run, INDEX.format(kind=kind))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): every row with the copy that stays."""

    hashed, _ = settle(digests(docs), "digests")
    total = hashed.count()
    index, _ = settle(updated(None, insertions(hashed), parts=max(8, -(-total // PART_ROWS))),
                      "digest-index")
    found = attach_groups(hashed, index.withColumnRenamed("digest", "text_sha256"),
                          "text_sha256", "group_size", total, F.col("doc_id"))
    return found.select("doc_id", "keep_id", "group_size",
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
