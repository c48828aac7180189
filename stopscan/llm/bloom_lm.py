"""Language-model scores from a log-frequency Bloom filter.

Words are counted over every training text. The `CLASSES` most frequent words are classes of their
own and all others share one, so there are at most (CLASSES + 2) squared pairs of neighbouring
classes, whatever the size of the corpus. The filter holds the counts of classes and of pairs on a
logarithmic scale: an item seen c times is entered once for each level 1 .. 1 + floor(log2 c). To
look an item up, its levels are probed one after another until one is missing; the last level found
gives the count back, to its power of two. The filter is built in parts, each by one task, and its
size follows from the bound on pairs, so it is safe to broadcast.

A token's probability starts from that of its class after the class before it, times that of the word
in its class. The first mixes the pair's count with the class's (a Dirichlet prior of `PRIOR` tokens);
the second is 1 for a word that is its own class, and add-one over all rarer words otherwise.

That is the prior of all other pairs of words, those of which one word at least is no class of its own.
Every such pair of the training texts is counted, however rare, and entered in a second filter of as many
parts as the entries need, by hash. No task sees all of it: the pairs of a text are sent to the parts that
hold them. With s the pair's count of the filter and p the prior, the probability after a rare word seen
z times is (s + PRIOR p) / (z + PRIOR), and after a class the same for the word in its class, z being the
count of the class before rare words. It adds up to 1 as far as counts are powers of two.

Exact counts of the `HEAD_WORDS` most frequent words, a bound whatever the corpus, are broadcast.
Rarer words, a small part of the tokens, meet their counts in a shuffle by word; no word in it is
frequent in training, and one that is frequent in other texts only is split by the skew join.

Defined results: words are runs without ASCII white space, with A-Z lower-cased; every text ends in
one end token, so a null or empty text has one token. Repeated rows are scored each. With nothing to
train on, counts are zero: base_score is 0 per token, score likewise. An empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import held_out, settle

CLASSES = 2048
HEAD_WORDS = 300_000
PRIOR = 200.0
BITS_PER_ENTRY = 12
PROBES = 8
PARTS = 64
FLUSH_WORDS = 300_000
#: Pairs of words, or probes of them, that one part of the second filter is made for.
PAIRS_PER_PART = 1 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The end token; no word is empty.
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""

    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LogFilter:
    """Bits of PARTS equal parts, each an array of bytes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def part_of(keys: np.ndarray, parts: int = PARTS) -> np.ndarray:
        return (mixed(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                % np.uint64(parts)).astype(np.int64)

    @staticmethod
    def places(keys: np.ndarray, level: np.ndarray | int, size: int) -> np.ndarray:
        """The PROBES bits, within its part, of each key at a level."""

        base = keys.astype(np.uint64) * np.uint64(64) + np.asarray(level).astype(np.uint64)
        one = mixed(base + np.uint64(0x632BE59BD9B4E019))
        two = mixed(base ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        turn = np.arange(PROBES, dtype=np.uint64)
        return ((one[:, None] + turn * two[:, None]) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def filled(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """One part of `size` bits holding the levels of its keys' counts."""

        bits = np.zeros(size, bool)
        levels = np.log2(counts).astype(np.int64) + 1
        for level in range(1, int(levels.max(initial=0)) + 1):
            bits[LogFilter.places(keys[levels >= level], level, size)] = True
        return np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level found in unbroken succession; 0 if the item is absent."""

        found, live, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        if not self.bits.shape[1]:
            return found
        part = self.part_of(keys, len(self.bits))
        while len(live):
            at = self.places(keys[live], level, self.bits.shape[1] * 8)
            hit = (self.bits[part[live][:, None], at >> 3] >> (at & 7) & 1).all(axis=1)
            live = live[hit]
            found[live] = level
            level += 1
        return found


def count_at(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its power of two."""

    return np.where(level > 1, 1.5 * 2.0 ** (np.maximum(level, 1) - 1), level.astype(float))


def class_key(name: np.ndarray) -> np.ndarray:
    return name.astype(np.int64) + (1 << 40)


class Model:
    """Head words, the filter, and what normalises it."""

    def __init__(self, head: pa.Table, classes: int, tokens: int, types: int, rare_tokens: int,
                 rare_types: int) -> None:
        self.words, self.counts = head.column(0), head.column(1).to_numpy()
        self.classes, self.tokens, self.types = classes, tokens, types
        self.rare = rare_tokens + rare_types + 1
        self.filter = LogFilter(np.zeros((PARTS, 0), np.uint8))
        self.after = np.zeros(classes + 1)
        self.alone = np.zeros(classes + 1)
        self._ids: dict[bytes, int] | None = None
        self._hashes: np.ndarray | None = None

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the head, which is also its class below `classes`; -1 if rare."""

        if self._ids is None:
            self._ids = {w: n for n, w in enumerate(self.words.to_pylist())}
        get = self._ids.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def word_keys(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """A hash of each word, whose numbers are `ids`."""

        if self._hashes is None:
            self._hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words.to_pylist()] + [0],
                                    np.uint64)
        found = self._hashes[ids]
        for at in np.flatnonzero(ids < 0).tolist():
            found[at] = xxhash.xxh64_intdigest(words[at])
        return found

    def outer_pairs(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that with the word before them are not two classes, the hash of that pair, and the
        number of the word before."""

        end = int(self.ids([END])[0])
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts] = end
        at = np.flatnonzero((self.class_of(before) == self.classes)
                            | (self.class_of(ids) == self.classes))
        own = self.word_keys(words, ids)
        past = np.empty_like(own)
        past[1:] = own[:-1]
        past[starts] = xxhash.xxh64_intdigest(END)
        keys = mixed(past[at] * np.uint64(0x9E3779B97F4A7C15) + own[at])
        return at, keys.view(np.int64), before[at]

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids >= 0) & (ids < self.classes), ids, self.classes)

    def pairs(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of (class before, class); a text begins after an end token."""

        before = np.empty_like(classes)
        before[1:] = classes[:-1]
        before[starts] = self.end_class
        return before * (self.classes + 1) + classes

    @property
    def end_class(self) -> int:
        return int(self.class_of(self.ids([END]))[0])

    def class_scores(self, pairs: np.ndarray) -> np.ndarray:
        """log10 of the probability of the class after the class before it."""

        if not self.tokens:
            return np.zeros(len(pairs))
        unique, place = np.unique(pairs, return_inverse=True)
        before, now = unique // (self.classes + 1), unique % (self.classes + 1)
        seen = count_at(self.filter.levels(unique))
        single = (self.alone[now] + 0.5) / (self.alone.sum() + 0.5 * (self.classes + 1))
        return np.log10((seen + PRIOR * single) / (self.after[before] + PRIOR))[place]


def batch_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All tokens of some texts, end tokens included, and where each text starts."""

    flat, starts = [], np.empty(len(texts), np.int64)
    for n, text in enumerate(texts):
        starts[n] = len(flat)
        flat += words_of(text)
        flat.append(END)
    return flat, starts


def pieces(texts: list[str | None], size: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of a batch with about `size` characters."""

    first, held = 0, 0
    for n, text in enumerate(texts):
        held += len(text or "")
        if held > size:
            yield first, n + 1
            first, held = n + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of every token of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                names=["word", "c"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                held[END] += 1
                if len(held) > FLUSH_WORDS:
                    yield told()
        if held:
            yield told()

    return train.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(
        F.sum("c").alias("c"))


def pair_counts(train: DataFrame, shipped) -> DataFrame:
    """(pair, c) of every two neighbouring classes of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        total = np.zeros((model.classes + 1) ** 2, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in pieces(texts):
                words, starts = batch_words(texts[i:j])
                pairs = model.pairs(model.class_of(model.ids(words)), starts)
                names, counts = np.unique(pairs, return_counts=True)
                total[names] += counts
        names = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total[names])],
                                         names=["pair", "c"])

    return train.select("text").mapInArrow(run, "pair bigint, c bigint").groupBy("pair").agg(
        F.sum("c").alias("c"))


def word_pairs(train: DataFrame, shipped) -> DataFrame:
    """(key, c) of every two neighbouring words of the training texts that are not both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shipped.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i, j in pieces(texts):
                words, starts = batch_words(texts[i:j])
                _, keys, _ = model.outer_pairs(words, model.ids(words), starts)
                names, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)],
                                                 names=["key", "c"])

    return train.select("text").mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(
        F.sum("c").alias("c"))


def learned(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the settled counts (word, c) of all words."""

    spark = train.sparkSession
    words, _ = settle(word_counts(train), "word-counts")
    sizes = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    tokens, types = sizes[0] or 0, sizes[1]

    def least(most: int) -> int:
        """The smallest count that at most `most` words reach."""

        if types <= most:
            return 1
        by_count = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c"))
        # Of n tokens there are fewer than sqrt(2n) different counts.
        total, found = 0, 1 << 62
        for row in by_count.toLocalIterator():
            total += row["n"]
            if total > most:
                break
            found = row["c"]
        return found

    head = words.where(F.col("c") >= least(HEAD_WORDS)).orderBy(F.desc("c"), "word").toArrow()
    counts = head.column("c").to_numpy() if len(head) else np.zeros(0, np.int64)
    classes = int((counts >= least(CLASSES)).sum())
    known = counts[:classes].sum()
    model = Model(head, classes, tokens, types, int(tokens - known), int(types - classes))
    shipped = spark.sparkContext.broadcast(model)
    pairs, _ = settle(pair_counts(train, shipped), "class-pairs")
    after = pairs.withColumn("level", F.floor(F.log2("c")) + 1).groupBy(
        F.floor(F.col("pair") / (classes + 1)).alias("before")).agg(F.sum(F.when(
            F.col("level") > 1, 1.5 * F.pow(F.lit(2.0), F.col("level") - 1)).otherwise(
            F.lit(1.0))).alias("z")).toArrow()
    if len(after):
        model.after[after.column("before").to_numpy()] = after.column("z").to_numpy()
    single = pairs.groupBy((F.col("pair") % (classes + 1)).alias("name")).agg(
        F.sum("c").alias("c"))
    items, _ = settle(pairs.select(F.col("pair").alias("key"), "c").unionByName(
        single.select((F.col("name") + (1 << 40)).alias("key"), "c")), "filter-items")
    entries = items.agg(F.sum(F.floor(F.log2("c")) + 1)).first()[0] or 0
    # Parts are dealt by hash; an eighth more than the mean leaves room for the fullest.
    part_bits = -(-int(entries / PARTS * 1.125 * BITS_PER_ENTRY + 64) // 8) * 8

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        bits = LogFilter.filled(frame["key"].to_numpy(), frame["c"].to_numpy(), part_bits)
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "bits": [bits.tobytes()]})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(
                LogFilter.part_of(batch.column(0).to_numpy())))

    parts = items.mapInArrow(dealt, "key bigint, c bigint, part bigint").groupBy(
        "part").applyInPandas(build, "part bigint, bits binary").toArrow()
    bits = np.zeros((PARTS, part_bits // 8), np.uint8)
    for part, told in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        bits[part] = np.frombuffer(told, np.uint8)
    model.filter = LogFilter(bits)
    model.alone = count_at(model.filter.levels(class_key(np.arange(classes + 1))))
    model._ids = model._hashes = None
    shipped.unpersist()
    return model, words


ROWS = ("uid bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, "
        "rare bigint, word binary, times bigint, key bigint, prior float")


def lifted(pairs: DataFrame, probes: DataFrame, number: int) -> DataFrame:
    """(uid, lift): what the counts of word pairs add to the score of the text that each of `number`
    probes is of.

    Both are dealt to the parts of the filter by hash; a part is built from its pairs and probed in one
    task. A pair has a word beyond the `CLASSES` most frequent, so no part is much larger than others.
    """

    entries = pairs.agg(F.sum(F.floor(F.log2("c")) + 1)).first()[0] or 0
    parts = max(1, -(-max(entries, number) // PAIRS_PER_PART))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")

    def probed(held: pa.Table, asked: pa.Table) -> pa.Table:
        keys, counts = (held.column(c).to_numpy() for c in ("key", "c"))
        size = int((np.log2(counts).astype(np.int64) + 1).sum()) * BITS_PER_ENTRY + 64
        bits = LogFilter.filled(keys, counts, -(-size // 8) * 8)
        unique, place = np.unique(asked.column("key").to_numpy(), return_inverse=True)
        seen = count_at(LogFilter(bits[None, :]).levels(unique))[place]
        hit = seen > 0
        prior = asked.column("prior").to_numpy()[hit]
        lift = asked.column("times").to_numpy()[hit] * np.log10(
            seen[hit] / (PRIOR * 10.0 ** prior.astype(float)) + 1.0)
        return pa.table({"uid": asked.column("uid").to_numpy()[hit], "lift": lift})

    return pairs.select(part, "key", "c").groupBy("part").cogroup(
        probes.select(part, "uid", "key", "times", "prior").groupBy("part")).applyInArrow(
        probed, "uid bigint, lift double")


def scores(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`."""

    model, words = learned(train)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select("doc_id", "text")
    kind = dict(chosen.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its frequent words give, and one for each rare word."""

        model: Model = shipped.value
        logs, apart = np.log10(model.counts + 1.0), math.log10(model.rare)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in pieces(texts):
                flat, starts = batch_words(texts[i:j])
                ids = model.ids(flat)
                n = j - i
                sizes = np.diff(np.append(starts, len(flat)))
                rare = ids < 0
                known = np.add.reduceat(~rare, starts, dtype=np.int64)
                base = np.add.reduceat(np.where(rare, 0.0, logs[ids]) if len(logs)
                                       else np.zeros(len(ids)), starts)
                classes = model.class_of(ids)
                score = model.class_scores(model.pairs(classes, starts))
                # A frequent word outside the classes: its share of the common class.
                inside = (classes == model.classes) & ~rare
                if inside.any():
                    score[inside] += logs[ids[inside]] - apart
                outer, keys, before = model.outer_pairs(flat, ids, starts) if model.tokens else (
                    np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                told = model.pairs(classes, starts)[outer]
                after = told // (model.classes + 1) < model.classes
                # The prior of the word in its class after a class, of class and word after a rare word.
                prior = np.where(after, np.where(inside[outer], logs[ids[outer]] - apart, 0.0)
                                 if len(logs) else 0.0, score[outer])
                z = np.zeros(len(outer))
                z[after] = count_at(model.filter.levels(told[after]))
                head = ~after & (before >= 0)
                z[head] = model.counts[before[head]]
                known_z = after | (before >= 0)
                # What a pair never seen has; a word before it beyond the head meets its count later.
                score[outer] += math.log10(PRIOR) - np.where(known_z, np.log10(z + PRIOR), 0.0)
                total = np.add.reduceat(score, starts)
                name = np.arange(uid, uid + n)
                uid += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), batch.column(0).slice(i, n), pa.array(sizes),
                     pa.array(known), pa.array(base), pa.array(total), pa.array(sizes - known),
                     pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.float32())], schema=schema)
                at = np.flatnonzero(rare)
                owner = np.repeat(name, sizes)[at].tolist()
                found = Counter(zip(owner, map(flat.__getitem__, at.tolist())))
                m = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in found], pa.int64()),
                     pa.nulls(m, schema.field("doc_id").type),
                     *[pa.nulls(m, schema.field(k).type) for k in range(2, 7)],
                     pa.array([k[1] for k in found], pa.binary()),
                     pa.array(found.values(), pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.float32())], schema=schema)
                text = np.repeat(name, sizes)[outer]
                order = np.lexsort((keys, text))
                new = np.ones(len(outer), bool)
                new[1:] = (np.diff(text[order]) != 0) | (np.diff(keys[order]) != 0)
                once, m = order[new], int(new.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text[once]), pa.nulls(m, schema.field("doc_id").type),
                     *[pa.nulls(m, schema.field(k).type) for k in range(2, 7)],
                     pa.array([flat[x] if rare[x] else None for x in outer[once].tolist()],
                              pa.binary()),
                     pa.array(np.diff(np.append(np.flatnonzero(new), len(outer)))),
                     pa.array(keys[once]), pa.array(prior[once], pa.float32())], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ROWS.format(kind=kind)).schema)
    rows, _ = settle(chosen.mapInArrow(run, ROWS.format(kind=kind)), "scored")
    whole = math.log10(model.tokens + model.types + 1)
    apart = math.log10(model.rare) if model.tokens else 0.0
    seen, count = F.coalesce("c", F.lit(0)), F.col("times")
    # A word beyond the head is once the word before another for each time that it is a token.
    rare = rows.where("word is not null AND key is null").select("uid", "word", "times").join(
        words, "word", "left").select(
        "uid", F.when(seen > 0, count).otherwise(0).alias("more_known"),
        (count * F.log10(seen + 1.0)).alias("more"),
        (-count * F.log10(seen + PRIOR) if model.tokens else F.lit(0.0)).alias("lift"))
    asked = rows.where("key is not null").select("uid", "word", "times", "key", "prior")
    late = asked.where("word is not null").join(words, "word", "left").select(
        "uid", "times", "key", (F.col("prior") + F.log10(seen + 1.0) - apart).cast("float").alias("prior"))
    probes = asked.where("word is null").select("uid", "times", "key", "prior").unionByName(late)
    pairs, _ = settle(word_pairs(train, shipped), "word-pairs")
    zero = F.lit(0).cast("bigint")
    by_text = rare.unionByName(lifted(pairs, probes, asked.count()).select(
        "uid", zero.alias("more_known"), F.lit(0.0).alias("more"), "lift")).groupBy("uid").agg(
        *[F.sum(c).alias(c) for c in ("more_known", "more", "lift")])
    more, lift = (F.coalesce(c, F.lit(0.0)) for c in ("more", "lift"))
    return rows.where("word is null AND key is null").join(by_text, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias(
            "n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + more - F.col("rare") * apart + lift).alias("score"))


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every row, learned from the rows that are not held out."""

    found = scores(docs, docs.where(~held_out(7, 2)))
    return found.select("doc_id", held_out(7, 2).alias("held_out"), *found.columns[1:])
