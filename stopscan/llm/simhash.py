"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's fingerprint takes, for each of 64 bits, the majority over the XXH64 values (seed 42)
of its word shingles. Two fingerprints are linked if they differ in at most 4 bits, and linked
documents form components.

The join. A fingerprint is cut into three segments of 22, 21 and 21 bits. The perfect binary Golay
code of length 23 decodes any word within three bits of exactly one of its 4,096 codewords. The
*tolerant* keys of a segment are the codewords that the segment and its one-bit neighbours decode
to (one to six of them): two segments at most two bits apart have a common neighbour, hence a
common tolerant key. The *exact* key of a segment is the segment, and its *half* keys are its two
halves, one of which survives one error. With four errors in all, by pigeonhole:

* if some segment has no error, another has at most two: exact key of one with a tolerant key of
  another (six families);
* else every segment has an error, so two have exactly one and the third at most two: half keys of
  two with a tolerant key of the third (three families).

So every link shares a key of at least 33 bits, found by an equal join of keys and verified by
counting bits. Work grows with the number of distinct fingerprints; copies share one.

Within a bucket of equal keys, links are reduced to a forest in the task that holds it, so a bucket
emits fewer rows than it has members and never its pairs. A bucket with over `BUCKET` members is
cut into blocks, and each two blocks are joined up in a task of their own, so no task holds a large bucket.

Defined results: A-Z are lower-cased, words are maximal runs without ASCII white space; fewer words
than a shingle give one shingle of them all; a null, empty or blank text has fingerprint zero and
is linked like any other. Repeated rows of an id stay separate rows with the same component. A null
doc_id takes part and never names a component unless it stands alone. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import attach_groups, components, if_small, keep_rows, keyed_rows, settle
from stopscan.llm.shingle_similarity import similar_groups

WORDS = 4
DISTANCE = 4
SEED = 42
#: Distinct fingerprints of one key that are compared in one task.
BUCKET = 8192
#: (shift, width) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code of length 23.
GENERATOR = 0b101011100011

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one whole text."""

    row = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not row:
        return 0
    if len(row) <= words:
        return xxhash.xxh64_intdigest(b" ".join(row), SEED)
    joined = b" ".join(row)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: len(row) - words] + 1).tolist()]
    stops = [*spaces[words - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    bits = np.unpackbits(np.frombuffer(b"".join(
        [digest(joined[i:j], SEED) for i, j in zip(starts, stops)]), np.uint8))
    # Eight counters to a machine word: 255 rows at a time cannot overflow a byte.
    lanes = bits.view(np.uint64).reshape(-1, 8)
    whole = len(lanes) // 255 * 255
    ones = np.zeros(64, np.int64)
    if whole:
        sums = lanes[:whole].reshape(-1, 255, 8).sum(axis=1)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    ones += lanes[whole:].sum(axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, bits): one row per document row; `bits` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(texts[i].as_py(), words) for i in range(len(texts))),
                                np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))],
                                             names=["doc_id", "bits"])

    chosen = docs.select("doc_id", "text")
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, bits bigint")


def golay_table() -> np.ndarray:
    """For every 23-bit word, the message (12 bits) of the one codeword within three bits."""

    def remainder(words: np.ndarray) -> np.ndarray:
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        return rest

    ones = 1 << np.arange(23)
    singles = np.concatenate(([0], ones))
    pairs = (ones[:, None] | ones[None, :])[np.triu_indices(23, 1)]
    triples = np.array([a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i])
                        for c in ones[:j]])
    errors = np.concatenate((singles, pairs, triples))
    by_syndrome = np.zeros(2048, np.int64)
    by_syndrome[remainder(errors)] = errors
    words = np.arange(1 << 23)
    return ((words ^ by_syndrome[remainder(words)]) >> 11).astype(np.int16)


_DECODED: list[np.ndarray] = []


def tolerant_keys(segment: np.ndarray, width: int) -> np.ndarray:
    """Per segment, six codeword numbers; repeated ones are -1."""

    if not _DECODED:
        _DECODED.append(golay_table())
    decode = _DECODED[0]
    around = np.concatenate(([0], 1 << np.arange(width)))
    every = np.sort(decode[segment[:, None] ^ around[None, :]], axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    return np.sort(every, axis=1)[:, ::-1][:, :7]


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in `values`): every key of every fingerprint."""

    parts = [(values >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in SEGMENTS]
    tolerant = [tolerant_keys(p, w) for p, (_, w) in zip(parts, SEGMENTS)]
    halves = [[p & 0x7FF, (p >> 11) | (1 << 11)] for p in parts]
    keys, owners = [], []
    place = np.arange(len(values))

    def add(family: int, exact: np.ndarray, soft: np.ndarray) -> None:
        here = soft >= 0
        keys.append(((np.int64(family) << 40) | exact[:, None] << 12 | soft)[here])
        owners.append(np.broadcast_to(place[:, None], soft.shape)[here])

    for i in range(3):
        for j in range(3):
            if i != j:
                add(3 * i + j, parts[i], tolerant[j].astype(np.int64))
        a, b = (k for k in range(3) if k != i)
        for x in halves[a]:
            for y in halves[b]:
                add(9 + i, x << 12 | y, tolerant[i].astype(np.int64))
    return np.concatenate(keys), np.concatenate(owners)


def fuzzy_keys(distinct: DataFrame) -> DataFrame:
    """(key, bits): the fuzzy keys of every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                chunk = values[at:at + 4096]
                key, owner = keys_of(chunk.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(chunk[owner])],
                                                 names=["key", "bits"])

    return distinct.select("bits").mapInArrow(run, "key bigint, bits bigint")


def close(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other) <= DISTANCE


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is linked among distinct `values`, fewer than there are values."""

    left, links = values, []
    while len(left):
        group, left = left[:1], left[1:]
        fresh = group
        while len(fresh) and len(left):
            near = np.zeros(len(left), bool)
            for v in fresh:
                hit = ~near
                hit[hit] = close(left[hit], v)
                links.extend((int(x), int(v)) for x in left[hit])
                near |= hit
            fresh, left = left[near], left[~near]
    return links


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])],
                                      names=["a", "b"])


def links_in_buckets(distinct: DataFrame) -> DataFrame:
    """(a, b): verified links of fingerprints with a common key, every component joined up."""

    def reduced(key: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, links = bits.view(np.uint64), []
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        two = stops - starts == 2
        a, b = values[starts[two]], values[starts[two] + 1]
        pair = close(a, b)
        links.extend(zip(a[pair].tolist(), b[pair].tolist()))
        for i, j in zip(starts[stops - starts > 2], stops[stops - starts > 2]):
            links.extend(forest(values[i:j]))
        if links:
            found = _link_batch(links)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(links), pa.int64())],
                                             names=["a", "b", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in order of key. A bucket may continue in the next batch; one that has
        outgrown BUCKET is named and let go."""

        empty, large = np.zeros(0, np.int64), None
        held_key, held = empty, empty
        for batch in batches:
            key = np.concatenate((held_key, batch.column(0).to_numpy()))
            bits = np.concatenate((held, batch.column(1).to_numpy()))
            if large is not None:
                past = np.searchsorted(key, large, "right")
                key, bits = key[past:], bits[past:]
            if not len(key):
                held_key, held = empty, empty
                continue
            last = np.searchsorted(key, key[-1])
            if last:
                yield from reduced(key[:last], bits[:last])
            held_key, held = key[last:], bits[last:]
            if len(held) > BUCKET:
                large, held_key, held = int(held_key[0]), empty, empty
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([large])],
                    names=["a", "b", "large"])
        if len(held):
            yield from reduced(held_key, held)

    def blocks(key: tuple, rows: pa.Table) -> pa.Table:
        values = rows.column("bits").to_numpy().view(np.uint64)
        found = forest(values)
        return pa.Table.from_batches([_link_batch(found)])

    keyed = fuzzy_keys(distinct)
    found, _ = settle(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(
        run, "a bigint, b bigint, large bigint"), "bucket-links")
    links = found.where("large is null").select("a", "b")
    large = found.where("large is not null").select(F.col("large").alias("key"))
    number = large.count()
    if not number:
        return links
    members, _ = settle(keyed.join(if_small(large, number, 16), "key"), "large-buckets")
    sizes = members.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / (BUCKET // 2)).cast("int").alias("parts"))
    dealt = members.join(if_small(sizes, number, 24), "key").withColumn(
        "part", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
    pairs = dealt.select("key", "bits", "part", F.explode(F.sequence(
        F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "key", "bits", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    return links.unionByName(pairs.groupBy("key", "i", "j").applyInArrow(
        blocks, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id): every document row with the class it belongs to."""

    printed, _ = settle(fingerprints(docs, words), "fingerprints")
    distinct, _ = settle(printed.groupBy("bits").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    total = printed.count()
    joined = components(links_in_buckets(distinct), "links")
    rooted = distinct.join(joined.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes, _ = settle(rooted.join(named, "root").select("bits", "n", "component_id"), "classes")
    found = attach_groups(printed, classes, "bits", "n", total, F.col("doc_id"))
    return found.select("doc_id", as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Copies here are texts that share 80% of their five-word shingles. Fingerprints link first, and what
    they link is checked on whole sets; since copies may be further apart than fingerprints can tell,
    `shingle_similarity` then looks among what is still apart. Rows are told apart by id
    and content: of an id with two texts each is kept or dropped by itself, a row without an id
    stays only where its group has no row with one, and of equal rows one stays.
    """

    keyed = keyed_rows(docs)
    printed, _ = settle(near_duplicates(keyed).select("doc_id", "component_id"), "print-copies")
    found, _ = settle(similar_groups(keyed, linked=printed), "near-copies")
    dropped, _ = settle(found.where(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias("key")), "near-copies-dropped")
    repeated, _ = settle(found.where(F.col("doc_id") == F.col("component_id")).groupBy(
        F.col("doc_id").alias("key")).count().where("count > 1").select("key"), "repeated-rows")
    return keep_rows(docs, dropped, repeated)
