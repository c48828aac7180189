"""Near copies by shingle similarity: candidates by MinHash bands and by prefixes, every link checked
on whole sets.

A document is the set of its word shingles (XXH64, seed 42). Two documents are linked if their sets
have a Jaccard similarity of at least `percent` / 100, and linked documents form components.

At similarity 0.8 two 64-bit SimHash fingerprints differ in about ten bits, which no long key
survives, so candidates come from MinHash instead: `BANDS` keys of `ROWS` minima each. A pair of
similarity s has no common key with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8, less above. What bands
leave apart is found by prefixes, which miss nothing. In a set of n shingles at most n - a, a being n *
`percent` / 100 rounded up, are missing from a set linked to it. So of the common shingles in order the
first k are among the n - a + k first of either set, for any order that all sets share. A set stays in
question while so many of its first shingles are also among the first of a set of another component; what
is left is compared within the clusters that common first shingles form. No link is made without counting
the common shingles of both whole sets.

Bands are taken in `ROUNDS`. After each, components are joined up, and a later round reads only
buckets that hold more than one component, so sets travel for what is still undecided. In a bucket
links are reduced to a forest; one with over `CROWD` members is cut into blocks, and each two
blocks meet in a task of their own. Equal sets share one entry throughout.

Defined results: A-Z are lower-cased, words are maximal runs without ASCII white space; fewer words
than a shingle give one shingle of them all; null, empty and blank texts are copies of each other.
A null doc_id takes part and never names a component unless it stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import attach_groups, components, if_small, settle

WORDS = 5
PERCENT = 80
SEED = 42
ROWS = 4
BANDS = 32
#: Ends of the rounds in bands.
ROUNDS = (3, BANDS)
#: Members of a bucket that are compared in one task.
CROWD = 2048
#: One in so many shingles of a set is looked for in other sets' prefixes.
SHARED = 20
#: Times at most that sets which share too little are left out before clusters form.
TRIMS = 3

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FACTORS = np.random.default_rng(SEED).integers(
    0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""

    row = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined = b" ".join(row)
    if len(row) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces[: len(row) - words] + 1).tolist()]
    stops = [*spaces[words - 1:].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join(
        [digest(joined[i:j], SEED) for i, j in zip(starts, stops)]), ">u8").astype(np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's number and its ROWS minima."""

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (FACTORS * found[at:at + 4096]).min(axis=1), out=least)
    width = ROWS * 8
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[b * width:(b + 1) * width], b)
                     for b in range(BANDS)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print, keys): per document row a digest of its set and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(band_keys(found))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.arange(len(keys) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "print", "keys"])

    chosen = docs.select("doc_id", "text")
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, print binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(print, members): the whole set of every document row, under its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(t.as_py(), words) for t in batch.column(0).slice(at, 512)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                     pa.ListArray.from_arrays(
                         pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))],
                    names=["print", "members"])

    return docs.select("text").mapInArrow(run, "print binary, members array<bigint>")


def forest(ends: np.ndarray, values: np.ndarray, roots: np.ndarray,
           percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of different `roots` that join all that is similar, by position.

    Set k is values[ends[k]:ends[k + 1]], without repeats. Members of a root are joined already.
    """

    number = len(ends) - 1
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(number), sizes)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    begin = np.searchsorted(owner, np.arange(number + 1))
    holders = owner[np.argsort(inverse, kind="stable")]
    counts = np.where(counts > 1, counts, 0)
    first = np.cumsum(counts) - counts
    left, links = np.ones(number, bool), []
    while left.any():
        group = left & (roots == roots[np.argmax(left)])
        left &= ~group
        fresh = np.flatnonzero(group).tolist()
        while fresh and left.any():
            v = fresh.pop()
            held = inverse[begin[v]:begin[v + 1]]
            lengths = counts[held]
            at = np.repeat(first[held] - (np.cumsum(lengths) - lengths), lengths) + np.arange(
                lengths.sum())
            common = np.bincount(holders[at], minlength=number)
            near = left & (common * (100 + percent) >= percent * (sizes + sizes[v]))
            if near.any():
                links.extend((v, int(x)) for x in np.flatnonzero(near))
                near |= left & np.isin(roots, roots[near])
                left &= ~near
                fresh.extend(np.flatnonzero(near).tolist())
    return links


def links_of_round(docs: DataFrame, distinct: DataFrame, roots: DataFrame, low: int, high: int,
                   words: int, percent: int) -> DataFrame:
    """(a, b): checked links of sets with a common key in bands `low` up to `high`."""

    def linked(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        prints, roots = rows.column("print").to_pylist(), rows.column("root").to_pylist()
        number = {r: n for n, r in enumerate(dict.fromkeys(roots))}
        lists = rows.column("members").chunk(0) if rows.num_rows else []
        found = forest(lists.offsets.to_numpy() - lists.offsets[0].as_py(),
                       lists.flatten().to_numpy(), np.array([number[r] for r in roots]), percent)
        return pa.table({"a": pa.array([prints[x] for x, _ in found], pa.binary()),
                         "b": pa.array([prints[y] for _, y in found], pa.binary())})

    keyed = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root"),
        F.explode(F.slice("keys", low + 1, high - low)).alias("key"))
    open_keys, _ = settle(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("root")).alias("low"),
        F.max(F.xxhash64("root")).alias("high"))
        .where("low <> high").select(
            F.col("key").alias("open_key"),
            F.ceil(F.col("n") / (CROWD // 2)).cast("int").alias("parts")), "open-buckets")
    held, _ = settle(keyed.join(if_small(open_keys, open_keys.count(), 24),
                                F.col("key") == F.col("open_key")).select(
        "key", "print", "first_id", "root",
        F.when(F.col("parts") <= 2, F.lit(1)).otherwise(F.col("parts")).alias("parts")),
        "bucket-members")
    wanted = held.select(F.col("first_id").alias("wanted")).distinct()
    needed = docs.join(if_small(wanted, held.count(), 40),
                       F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    sets, _ = settle(shingle_sets(needed, words).dropDuplicates(["print"]), "shingle-sets")
    dealt = held.withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    pairs = dealt.select("key", "print", "root", "part", F.explode(F.sequence(
        F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "key", F.col("print").alias("own"), "root", F.least("part", "with").alias("i"),
        F.greatest("part", "with").alias("j"))
    return pairs.join(sets, F.col("own") == F.col("print")).select(
        "key", "i", "j", "print", "root", "members").groupBy("key", "i", "j").applyInArrow(
        linked, "a binary, b binary")


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(print, need, plain, tokens): the first shingles of every document row's set in order of hash. A
    link makes `need` of them common to both sets' tokens, and one of the first `plain`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingles(t.as_py(), words) for t in batch.column(0).slice(at, 512)]
                sizes = np.array([len(x) for x in found])
                least = -(-percent * sizes // 100)
                first = np.minimum(sizes, sizes - least + np.maximum(1, sizes // SHARED))
                ends = np.concatenate(([0], np.cumsum(first))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
                     # The other set has at least `least` shingles.
                     pa.array(np.maximum(1, least // SHARED)), pa.array(sizes - least + 1),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(
                         [x[:k] for x, k in zip(found, first)]).view(np.int64)))],
                    names=["print", "need", "plain", "tokens"])

    return docs.select("text").mapInArrow(
        run, "print binary, need bigint, plain bigint, tokens array<bigint>")


def clusters(docs: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(node, root): sets that may be linked to one of another root, under the cluster they are in."""

    named = if_small(roots, roots.count(), 64)
    held, _ = settle(prefixes(docs, words, percent).join(
        named, F.col("print") == F.col("node"), "left").select(
        "print", "need", "plain", "tokens", F.xxhash64(F.coalesce("root", "print")).alias("own")),
        "set-prefixes")
    total = held.count()
    for _ in range(TRIMS):
        shared, _ = settle(held.select("own", F.explode("tokens").alias("token")).groupBy("token").agg(
            F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select(
            "token"), "shared-shingles")
        few = if_small(shared, shared.count(), 24)
        # Rows of equal sets count together, which leaves no set out.
        stay, _ = settle(held.select("print", "need", F.explode("tokens").alias("token")).join(
            few, "token").groupBy("print", "need").agg(F.count(F.lit(1)).alias("n")).where(
            "n >= need").select("print"), "open-sets")
        held, _ = settle(held.join(if_small(stay, stay.count(), 40), "print", "left_semi"),
                         "open-prefixes")
        left = held.count()
        if not left:
            return None
        if left > 0.9 * total:
            break
        total = left
    met = held.select("print", F.explode(F.slice("tokens", F.lit(1), F.col("plain").cast(
        "int"))).alias("token")).join(few, "token")
    heads = met.groupBy("token").agg(F.min("print").alias("head"))
    return components(met.join(heads, "token").select(
        F.col("print").alias("a"), F.col("head").alias("b")).where("a <> b").distinct(), "clusters")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                   linked: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): every document row with the class it belongs to.

    `linked` holds groups (doc_id, component_id) found by another method. Their members are compared
    first, bands are read for what that leaves apart, and prefixes for what bands do.
    """

    signed, _ = settle(signatures(docs, words), "shingle-prints")
    distinct, _ = settle(signed.groupBy("print").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"),
        F.first("keys").alias("keys")), "distinct-sets")
    rounds = ROUNDS
    if linked is not None:
        groups = linked.groupBy(F.col("doc_id").alias("id")).agg(
            F.min(F.xxhash64("component_id")).alias("group"))
        # Equal sets may have been linked apart: one of their groups is enough to start from.
        started = signed.select("print", "doc_id").join(
            groups, F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("print").agg(
            F.min("group").alias("group"))
        distinct, _ = settle(distinct.join(started, "print").withColumn(
            "keys", F.concat(F.array("group"), "keys")).drop("group"), "linked-sets")
        rounds = (1, *[high + 1 for high in ROUNDS])
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a binary, b binary")
    joined = spark.createDataFrame([], "node binary, root binary")
    low = 0
    for high in rounds:
        more, _ = settle(links_of_round(docs, distinct, joined, low, high, words, percent),
                         "similar-links")
        if more.count():
            links = links.unionByName(more)
            joined, _ = settle(components(links, "similar"), "similar-roots")
        low = high
    near = clusters(docs, joined, words, percent)
    if near is not None:
        near, _ = settle(near.select("node", F.array(F.xxhash64("root")).alias("cluster")), "clustered")
        asked = distinct.join(near, F.col("print") == F.col("node")).select(
            "print", "first_id", F.col("cluster").alias("keys"))
        more, _ = settle(links_of_round(docs, asked, joined, 0, 1, words, percent), "similar-links")
        if more.count():
            joined, _ = settle(components(links.unionByName(more), "similar"), "similar-roots")
    rooted = distinct.join(joined, distinct["print"] == joined["node"], "left").select(
        "print", "first_id", "n", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes, _ = settle(rooted.join(named, "root").select("print", "n", "component_id"),
                        "similar-classes")
    return attach_groups(signed.select("doc_id", "print"), classes, "print", "n", signed.count(),
                         F.col("doc_id")).select("doc_id", "component_id")
