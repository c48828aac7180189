"""Trie of the turn prefixes that conversations share.

A prefix of turns is named by a digest that chains the digests of its turns; every `CHAIN` turns the
chain starts anew and only its ends are chained on, at fixed depths, so long conversations are digested
in pieces and equal prefixes get equal names. All digests are counted in a count-min sketch: each task
fills its own, they are added up cell by cell, and the sum is broadcast. A cell stops at two. An
estimate never lies below the count, so an estimate of one proves that only one conversation has the
prefix: such a node is known where it stands, with one member, one leaf and nothing saved, and is given
out there. Only prefixes with a higher estimate are shuffled, to be grouped exactly.

The smallest member of a node stands for it. What a node's subtree holds is summed over its members'
rows: every conversation adds at each of its depths what the nodes it stands for hold from there down,
as a running total along the conversation in pieces of `CHAIN` depths. Parents and children meet on
(conversation, depth), where rows are unique. So the first turn that a third of all conversations
share is a partial sum in every task.

The sketch has at most `MOST_CELLS` cells a row; beyond that more prefixes are grouped exactly than
need be, and the result is the same.

Defined results: rows without conv_id belong to no conversation and are left out. Rows of one turn stand
by role, then by the SHA-256 of their text; repeated rows are turns of their own. A null role or text is
empty. A text of any length is digested where it lies. A table without conversations has no nodes. Only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)
from pyspark.sql.window import Window

from stopscan.llm.common import attach_groups, settle

CHAIN = 256
#: Rows of the sketch, the fewest and the most cells of a row (one byte each).
HASHES = 3
LEAST_CELLS, MOST_CELLS = 1 << 12, 1 << 23
CELLS_PER_KEY = 8
#: Cells that travel together when the tasks' sketches are added up.
STRETCH = 1 << 12
FAMILY, HEAD = 20, 4
#: Bytes of joined ids that travel together to the hash of a node's ends.
ENDS_BYTES = 1 << 16


def _wider(df: DataFrame, **more: DataType) -> StructType:
    return StructType([*df.schema.fields, *[StructField(n, t) for n, t in more.items()]])


def placed(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `place`, the 0-based place of each row in its group, whatever a group's size.

    Rows are laid out by range, counted within their part of it, and the few groups that reach over
    several parts get the count of the parts before: at most one group per part.
    """

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for value in batch.column(at).to_pylist():
                count = count + 1 if value == now else 0
                now = value
                places.append(count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64()),
                 pa.array([part] * len(places), pa.int32())],
                names=[*batch.schema.names, "place", "__part"])

    found, _ = settle(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(
        key, *order).mapInArrow(run, _wider(rows, place=LongType(), __part=IntegerType())), name)
    sizes = found.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1))
    later = sizes.select(F.col(key).alias("__key"), F.col("__part").alias("__in"),
                         before.alias("__before")).where("__before > 0")
    return found.join(F.broadcast(later), (F.col(key) == F.col("__key")) & (
        F.col("__part") == F.col("__in")), "left").select(
        *rows.columns, (F.col("place") + F.coalesce("__before", F.lit(0))).alias("place"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, idx, turn_digest, words) of the rebuilt conversations, and all conversations
    (conv_id, turns)."""

    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("has_turn"),
        "turn", role.alias("role"), F.unhex(F.sha2(text, 256)).alias("text_digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    own, _ = settle(placed(turns, "conv_id", ["has_turn", "turn", "role", "text_digest"],
                           "trie-places").select(
        "conv_id", "place", "words", F.unhex(F.sha2(F.concat(
            F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"),
            F.col("role").cast("binary"), F.col("text_digest")), 256)).alias("turn_digest")),
        "trie-turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    sizes = sizes.withColumn("head", (F.crc32(F.col("conv_id").cast("string")) % HEAD)).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = sizes.select(F.col("conv_id").alias("__base"), F.col("own").alias("base_own"))
    sizes = sizes.join(bases, F.col("base") == F.col("__base"), "left").withColumn(
        "lent", F.least("head", F.coalesce("base_own", F.lit(0)))).withColumn(
        "turns", F.col("lent") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).select(
        "conv_id", "own", "head", "base", "lent", "turns")
    sizes, _ = settle(sizes, "trie-sizes")
    kept = attach_groups(own, sizes.select("conv_id", "own", "head", "lent"), "conv_id", "own",
                         own.count(), F.hash("place", "conv_id")).where("place >= head").select(
        "conv_id", (F.col("place") - F.col("head") + F.col("lent")).alias("idx"), "turn_digest", "words")
    # The first turns of a base go to the members of its family, a fixed number of ids.
    first = own.where(F.col("place") < HEAD - 1).select(
        F.col("conv_id").alias("__base"), "place", "turn_digest", "words")
    lent = sizes.where("lent > 0").join(first, (F.col("base") == F.col("__base"))
                                        & (F.col("place") < F.col("lent"))).select(
        "conv_id", F.col("place").alias("idx"), "turn_digest", "words")
    return kept.unionByName(lent), sizes.select("conv_id", "turns")


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def prefixes(turns: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(conv_id, depth, key, parent, words, ends) of every prefix of every conversation.

    `key` names the prefix, `parent` the one a turn shorter (empty: the root).
    """

    pieces = turns.groupBy("conv_id", F.floor(F.col("idx") / CHAIN).alias("piece")).agg(F.sort_array(
        F.collect_list(F.struct("idx", "turn_digest", "words"))).alias("rows"))
    sized = attach_groups(
        pieces, sizes.withColumn("__pieces", F.ceil(F.col("turns") / CHAIN)).where("turns > 0"),
        "conv_id", "__pieces", total, F.hash("piece", "conv_id"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each full piece."""

        for batch in batches:
            made = []
            for rows in batch.column(2).to_pylist():
                digest = b""
                for row in rows:
                    digest = _digest(digest, row["turn_digest"])
                made.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                              pa.array(made, pa.binary())],
                                             names=["conv_id", "piece", "digest"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams a conversation's full pieces in order; each piece after them gets the chain."""

        now, chain = None, b""
        for batch in batches:
            convs, made = batch.column(0).to_pylist(), []
            for conv, digest in zip(convs, batch.column(2).to_pylist()):
                if conv != now:
                    now, chain = conv, b""
                chain = _digest(chain, digest)
                made.append(chain)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.add(batch.column(1), 1), pa.array(made, pa.binary())],
                names=["__conv", "__piece", "chain"])

    sized, _ = settle(sized, "trie-pieces")
    full = sized.where((F.col("piece") + 1) * CHAIN < F.col("turns")).select("conv_id", "piece", "rows")
    chains = full.mapInArrow(ends, "conv_id bigint, piece bigint, digest binary").repartition(
        "conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(
        starts, "__conv bigint, __piece bigint, chain binary")
    ready = sized.join(chains, (F.col("conv_id") == F.col("__conv"))
                       & (F.col("piece") == F.col("__piece")), "left").select(
        "conv_id", "rows", "turns", "chain")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, rows, turns_, chain in zip(*[c.to_pylist() for c in batch.columns]):
                chain, digest = chain or b"", b""
                parent = chain
                for row in rows:
                    depth = row["idx"] + 1
                    digest = _digest(digest, row["turn_digest"])
                    # A full piece's last prefix is named as the start of the next piece sees it.
                    key = _digest(chain, digest) if depth % CHAIN == 0 else _digest(
                        b"part", chain, digest)
                    out.append((conv, depth, key, parent, row["words"], depth == turns_))
                    parent = key
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "depth", "key", "parent", "words", "ends"])

    return ready.mapInArrow(named, "conv_id bigint, depth bigint, key binary, parent binary, "
                                   "words bigint, ends boolean")


def cells(keys: list[bytes], width: int) -> np.ndarray:
    """The cells of each key, one column per row of the sketch; `width` is a power of two."""

    words = np.frombuffer(b"".join(keys), np.uint64).reshape(len(keys), 4)[:, :HASHES]
    return (words & np.uint64(width - 1)).astype(np.int64)


class Sketch:
    """Count-min counts, each cell at most two."""

    def __init__(self, width: int) -> None:
        self.counts = np.zeros((HASHES, width), np.uint8)

    def add(self, keys: list[bytes]) -> None:
        if keys:
            for row, at in zip(self.counts, cells(keys, self.counts.shape[1]).T):
                where, times = np.unique(at, return_counts=True)
                row[where] = np.minimum(2, row[where] + np.minimum(2, times))

    def lone(self, keys: list[bytes]) -> np.ndarray:
        """Whether the estimate of each key is one."""

        if not keys:
            return np.zeros(0, bool)
        at = cells(keys, self.counts.shape[1])
        return np.min([row[a] for row, a in zip(self.counts, at.T)], axis=0) == 1


def width_for(keys: int) -> int:
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_KEY * keys - 1).bit_length()))


def sketched(rows: DataFrame, width: int) -> Sketch:
    """The counts of all keys: tasks' sketches added up in stretches, which are spread over tasks."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(width)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        parts = own.counts.reshape(-1, STRETCH)
        used = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(used), 256):
            some = used[at:at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([parts[k].tobytes() for k in some], pa.binary())],
                names=["stretch", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(counts.as_buffer(), np.uint8)
                sums[k] = np.minimum(2, sums[k] + more) if k in sums else more.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()],
                                                        pa.binary())], names=["stretch", "counts"])

    kinds = "stretch bigint, counts binary"
    made = rows.select("key").mapInArrow(fill, kinds).repartition("stretch").mapInArrow(add, kinds)
    sketch = Sketch(width)
    flat = sketch.counts.reshape(-1, STRETCH)
    for row in made.toLocalIterator():
        flat[row["stretch"]] = np.frombuffer(row["counts"], np.uint8)
    return sketch


def screened(rows: DataFrame, sketch: Sketch) -> DataFrame:
    """`rows` with `lone` (proved to have one member) and `parent_lone`."""

    shipped = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            inner = [p for p in parents if p]
            found = np.zeros(len(parents), bool)
            found[[n for n, p in enumerate(parents) if p]] = shipped.value.lone(inner)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shipped.value.lone(keys)), pa.array(found)],
                names=[*batch.schema.names, "lone", "parent_lone"])

    return rows.mapInArrow(run, _wider(
        rows, lone=BooleanType(), parent_lone=BooleanType()))


def joined_ids(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256) from rows (key, conv_id): ids are laid out by range and joined in pieces, and
    the hash of a node reads its pieces in order, as SHA-256 must."""

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, held, size
            if held:
                out.append((now, number, ",".join(held)))
                number, held, size = number + 1, [], 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            found = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.binary()), pa.array([part] * len(out), pa.int32()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["key", "part", "number", "ids"])
            out.clear()
            return found

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now or size > ENDS_BYTES:
                    close()
                    now = key
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield made()
        close()
        if out:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []

        def made() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())],
                names=["key", "ends_sha256"])
            out.clear()
            return found

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield made()
        if now is not None:
            out.append((now, digest.hexdigest()))
            yield made()

    pieces = rows.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id") \
        .sortWithinPartitions("key", "conv_id").mapInArrow(
        join, "key binary, part int, number bigint, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "part", "number").select(
        "key", "ids").mapInArrow(hashed, "key binary, ends_sha256 string")


def _below(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Rows (conv_id, depth, ...) with the sum of each measure from their depth down, in pieces of CHAIN
    depths of a conversation."""

    piece = F.floor(F.col("depth") / CHAIN)
    totals = rows.groupBy("conv_id", piece.alias("__piece")).agg(
        *[F.sum(m).alias(f"__{m}") for m in measures])
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("__piece")).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("__conv"), "__piece", *[
        F.coalesce(F.sum(f"__{m}").over(deeper), F.lit(0)).alias(f"__{m}") for m in measures])
    inside = Window.partitionBy("conv_id", "__in").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, 0)
    placed_ = rows.withColumn("__in", piece)
    for m in measures:
        placed_ = placed_.withColumn(f"__own_{m}", F.sum(m).over(inside))
    joined = placed_.join(totals, (F.col("conv_id") == F.col("__conv"))
                          & (F.col("__in") == F.col("__piece")))
    return joined.select(*[c for c in rows.columns if c not in measures], *[
        (F.col(f"__own_{m}") + F.col(f"__{m}")).alias(m) for m in measures])


NOTHING = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256")


def _own_hash() -> Column:
    return F.sha2(F.col("conv_id").cast("string"), 256)


def nodes(conversations: DataFrame) -> DataFrame:
    """One row of COLUMNS per distinct prefix of the rebuilt conversations, the empty one included."""

    turns, sizes = rebuilt(conversations)
    turns, _ = settle(turns, "trie-rebuilt")
    total = turns.count()
    rows, _ = settle(prefixes(turns, sizes, total), "trie-prefixes")
    rows, _ = settle(screened(rows, sketched(rows, width_for(total))), "trie-screened")

    shared = rows.where("NOT lone")
    groups = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n_convs"),
                                       F.min("conv_id").alias("least"))
    known = attach_groups(shared, groups, "key", "n_convs", shared.count(),
                          F.hash("conv_id", "depth")).withColumn(
        "stands", F.col("conv_id") == F.col("least"))
    # Of the lone nodes, those below a shared one count as its children, and ends as leaves.
    lone = rows.where("lone AND (NOT parent_lone OR ends)").withColumns(
        {"n_convs": F.lit(1).cast("bigint"), "least": F.col("conv_id"), "stands": F.lit(True)})
    known, _ = settle(known.unionByName(lone), "trie-known")

    standing = known.where("stands")
    children = standing.where("NOT parent_lone").groupBy(F.col("parent").alias("__of")).agg(
        F.count(F.lit(1)).alias("n_children"))
    standing = standing.join(children, F.col("key") == F.col("__of"), "left").select(
        "conv_id", "depth", "key", "words", "ends", "lone", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"))
    standing, _ = settle(standing.withColumn("leaf", F.when(F.col("lone"), F.col("ends")).otherwise(
        F.col("n_children") == 0).cast("bigint")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("words")), "trie-standing")

    measured = known.select("conv_id", "depth", "key", "lone").join(standing.select(
        F.col("conv_id").alias("__conv"), F.col("depth").alias("__depth"), "leaf", "saved"), (
        F.col("conv_id") == F.col("__conv")) & (F.col("depth") == F.col("__depth")), "left").select(
        "conv_id", "depth", "key", "lone", *[F.coalesce(m, F.lit(0)).alias(m)
                                             for m in ("leaf", "saved")])
    sums = _below(measured, ["leaf", "saved"]).where("NOT lone").groupBy("key").agg(
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = joined_ids(shared.where("ends"))

    everyone = sizes.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).first()
    above = known.where("NOT lone").select(
        F.col("conv_id").alias("__conv"), (F.col("depth") + 1).alias("__depth"),
        F.col("least").alias("above"))

    def with_parent(df: DataFrame) -> DataFrame:
        """A parent that was grouped is on the row above in the same conversation; else it is lone."""

        return df.join(above, (F.col("conv_id") == F.col("__conv"))
                       & (F.col("depth") == F.col("__depth")), "left").withColumn(
            "parent_conv_id", F.when(F.col("depth") == 1, F.lit(everyone["least"]).cast("bigint"))
            .otherwise(F.coalesce("above", "conv_id")))

    grouped = with_parent(standing.where("NOT lone")).join(sums, "key").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    alone = (F.lit(1).cast("bigint").alias("n_convs"), (~F.col("ends")).cast("bigint").alias("n_children"),
             F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
             F.when(F.col("ends"), _own_hash()).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    tops = with_parent(rows.where("lone AND NOT parent_lone")).select(
        "conv_id", "depth", "parent_conv_id", *alone)
    tails = rows.where("lone AND parent_lone").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone)
    under = standing.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.sum(
        (F.col("depth") == 1).cast("int")).alias("children")).first()
    root_ends = joined_ids(sizes.where("turns = 0").select(F.lit(b"").alias("key"), "conv_id"))
    root = sizes.limit(1).select(
        F.lit(everyone["least"]).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(everyone["n"]).cast("bigint").alias("n_convs"),
        F.lit(under["children"] or 0).cast("bigint").alias("n_children"),
        F.lit(under["leaves"] if under["children"] else 1).cast("bigint").alias("n_leaves"),
        F.lit(under["saved"] or 0).cast("bigint").alias("saved_tokens"),
        F.lit(b"").alias("key")).join(root_ends, "key", "left").select(
        *COLUMNS[:-1], F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    return grouped.unionByName(tops).unionByName(tails).unionByName(root).select(*COLUMNS)
