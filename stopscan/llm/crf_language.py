"""Language of code-switched text by a linear-chain conditional random field over words.

Every word gets a label. Emissions are sums of learned weights of hashed features of the word: its
affixes of one to three letters, its letter pairs and triples, and the lexicons it stands in. The
transitions between labels are learned with them, by maximum likelihood with forward-backward, on
chains of words; every second training chain is spliced from two documents, so that switching
languages inside a text is something the model has seen. Forward-backward over a whole text gives
each word's label probabilities; the text takes the label with the largest mean probability, and
that mean is its score. `switches` returns the runs of words of one label.

Learning reads a bounded sample of the labelled rows: about `SAMPLE_DOCS` whole texts, shared evenly
among the labels and chosen by a hash of the id. Prediction reads every whole text.

Defined results: a word is a maximal run of letters. A null text, or one without a letter, is `und`
with score 0. Without any labelled row every text is `und` with score 0. Repeated rows get the same
prediction. An empty table gives an empty result. Only doc_id, text and lang are read, and lang only
for learning.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import byte_slices, held_out, id_text

SAMPLE_DOCS = 1600
FEATURES = 1 << 16
CHAIN = 24
CHAINS = 9000
STEPS = 30
#: Words whose emissions are kept, words of a piece of texts, and words turned into features at once:
#: together they bound a task's memory, whatever the number of different words.
CACHE_WORDS = 200_000
TOKENS = 200_000
WORD_BLOCK = 10_000
TEXT_BYTES = 4 << 20
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of one lower-cased word."""

    framed = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    names += [f"2{framed[i:i + 2]}" for i in range(len(framed) - 1)]
    names += [f"3{framed[i:i + 3]}" for i in range(len(framed) - 2)]
    if word in lexicon:
        names.append(f"lexicon {lexicon[word]}")
    return [zlib.crc32(n.encode()) & (FEATURES - 1) for n in names]


def lexicons(words: list[list[str]], labels: list[int], least: int = 5,
             purity: float = 0.9) -> dict[str, int]:
    """Words of the sample that nearly always carry one label, with that label."""

    seen: dict[str, Counter] = {}
    for row, label in zip(words, labels):
        for word in row:
            seen.setdefault(word, Counter())[label] += 1
    found = {}
    for word, counts in seen.items():
        label, most = counts.most_common(1)[0]
        if most >= least and most >= purity * sum(counts.values()):
            found[word] = label
    return found


class Crf:
    """Weights, transitions and the words already turned into emissions."""

    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray,
                 moves: np.ndarray, first: np.ndarray) -> None:
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.moves, self.first = weights, moves, first
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)))

    def emissions(self, words: list[str]) -> np.ndarray:
        """One row of label scores per word."""

        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            self.rows = self.rows[:0]
            fresh = list(dict.fromkeys(words))
        blocks = [self.rows]
        for at in range(0, len(fresh), WORD_BLOCK):
            features = [array("i", word_features(w, self.lexicon))
                        for w in fresh[at:at + WORD_BLOCK]]
            sizes = np.fromiter(map(len, features), np.int64, len(features))
            flat = np.frombuffer(b"".join(features), np.int32)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            blocks.append(np.add.reduceat(self.weights[flat], starts, axis=0)
                          / np.sqrt(sizes)[:, None])
        if fresh:
            known.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            self.rows = np.concatenate(blocks)
        return self.rows[np.fromiter((known[w] for w in words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of each word; texts lie one after another, longest first."""

        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(self.moves - self.moves.max())
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        found = np.empty_like(scores)
        now = np.exp(self.first - self.first.max()) * scores[starts]
        for step in range(lengths[0]):
            if step:
                at = starts[:live[step]] + step
                now = (now[:live[step]] @ move) * scores[at]
            else:
                at = starts
            now = now / now.sum(axis=1, keepdims=True)
            found[at] = now
        back = np.ones((0, len(self.labels)))
        for step in range(lengths[0] - 1, -1, -1):
            n = live[step]
            at = starts[:n] + step
            if len(back):
                back = (scores[at[:len(back)] + 1] * back) @ move.T
                back = back / back.sum(axis=1, keepdims=True)
            back = np.concatenate((back, np.ones((n - len(back), len(self.labels)))))
            both = found[at] * back
            found[at] = both / both.sum(axis=1, keepdims=True)
        return found

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean label probabilities of each text; texts lie one after another, longest first."""

        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return np.add.reduceat(self.marginals(scores, lengths), starts, axis=0) / lengths[:, None]

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(numbers of texts, their word counts, emissions of their words), longest text first."""

        # Long texts together: a step of the recursion then serves many of them.
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            words: list[str] = []
            sizes, owners = [], []
            while at < len(order) and len(words) < TOKENS:
                found = LETTERS.findall(texts[order[at]].lower())
                if found:
                    words += found
                    sizes.append(len(found))
                    owners.append(order[at])
                at += 1
            if not sizes:
                continue
            emitted = self.emissions(words)
            lengths = np.array(sizes)
            longest = np.argsort(-lengths, kind="stable")
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            shuffled = np.concatenate([np.arange(starts[k], starts[k] + lengths[k])
                                       for k in longest])
            yield [owners[k] for k in longest], lengths[longest], emitted[shuffled]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return labels, scores
        for owners, lengths, emitted in self.pieces(texts):
            mean = self.posteriors(emitted, lengths)
            best = mean.argmax(axis=1)
            for place, owner in enumerate(owners):
                labels[owner] = self.labels[best[place]]
                scores[owner] = min(1.0, mean[place, best[place]])
        return labels, scores

    def runs(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its runs of words of one label: first word, words, label, probability."""

        told: list[list[dict]] = [[] for _ in texts]
        if not self.labels:
            return told
        for owners, lengths, emitted in self.pieces(texts):
            found = self.marginals(emitted, lengths)
            best = found.argmax(axis=1)
            ends = np.cumsum(lengths)
            for owner, end, length in zip(owners, ends.tolist(), lengths.tolist()):
                own = best[end - length:end]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), length]
                for i, j in zip(cuts, cuts[1:]):
                    told[owner].append({
                        "first_word": i, "words": j - i, "lang": self.labels[own[i]],
                        "score": min(1.0, float(found[end - length + i:end - length + j,
                                                      own[i]].mean()))})
        return told


def chains(words: list[list[str]], labels: list[int], rng: np.random.Generator
           ) -> tuple[list[str], np.ndarray]:
    """Training chains of CHAIN words and their labels, every second one spliced from two texts.

    Every word of the sample is in a piece: the words left at the end of a text make one with those
    before them, and a text shorter than a chain is repeated until the chain is full.
    """

    pieces = [(row[i:i + CHAIN], label) for row, label in zip(words, labels)
              for i in range(0, len(row) - CHAIN + 1, CHAIN)]
    pieces += [((row * CHAIN)[:CHAIN] if len(row) < CHAIN else row[-CHAIN:], label)
               for row, label in zip(words, labels) if len(row) % CHAIN]
    by_label: dict[int, list] = {}
    for row, label in pieces:
        by_label.setdefault(label, []).append(row)
    names = sorted(by_label)

    def draw() -> tuple[list[str], int]:
        label = names[rng.integers(len(names))]
        return by_label[label][rng.integers(len(by_label[label]))], label

    flat: list[str] = []
    truth = np.empty((CHAINS, CHAIN), np.int64)
    for n in range(CHAINS):
        one, a = draw()
        cut = CHAIN
        if n % 2:
            cut = int(rng.integers(1, CHAIN))
            other, b = draw()
            one = one[:cut] + other[cut:]
            truth[n, cut:] = b
        truth[n, :cut] = a
        flat += one
    return flat, truth


def fit(texts: list[str], languages: list[str], seed: int = 0) -> Crf:
    """Maximum likelihood by full-gradient Adam steps; everything fits one machine by its bound."""

    labels = sorted(set(languages))
    # Each different word is held once, and a text as references to its words.
    once: dict[str, str] = {}
    words = [[once.setdefault(w, w) for w in LETTERS.findall(t.lower())] for t in texts]
    tags = [labels.index(v) for v in languages]
    kept = [k for k, row in enumerate(words) if row]
    words, tags = [words[k] for k in kept], [tags[k] for k in kept]
    labels, tags = ([labels[k] for k in sorted(set(tags))],
                    [sorted(set(tags)).index(t) for t in tags])
    lexicon, width = lexicons(words, tags), len(labels)
    model = Crf(labels, lexicon, np.zeros((FEATURES, width)), np.zeros((width, width)),
                np.zeros(width))
    if width < 2:
        return model
    flat, truth = chains(words, tags, np.random.default_rng(seed))
    words.clear()
    types = {w: n for n, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter((types[w] for w in flat), np.int64, len(flat)).reshape(CHAINS, CHAIN)
    features = [np.array(word_features(w, lexicon), np.int32) for w in types]
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    index = np.concatenate(features)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    owner, scale = np.repeat(np.arange(len(sizes)), sizes), 1 / np.sqrt(sizes)
    used, slot = np.unique(index, return_inverse=True)
    shape = len(used) * width
    theta = np.zeros(shape + width * width + width)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    here = np.eye(width)[truth]
    counted = np.einsum("nti,ntj->ij", here[:, :-1], here[:, 1:])
    for step in range(1, STEPS + 1):
        weights = theta[:shape].reshape(len(used), width)
        moves = theta[shape:shape + width * width].reshape(width, width)
        first = theta[shape + width * width:]
        unary = np.add.reduceat(weights[slot], starts, axis=0) * scale[:, None]
        score = unary[ids]
        score = np.exp(score - score.max(axis=2, keepdims=True))
        move = np.exp(moves)
        ahead, back = np.empty_like(score), np.ones_like(score)
        for t in range(CHAIN):
            now = score[:, t] * (np.exp(first) if t == 0 else ahead[:, t - 1] @ move)
            ahead[:, t] = now / now.sum(axis=1, keepdims=True)
        expected = np.zeros((width, width))
        for t in range(CHAIN - 2, -1, -1):
            after = score[:, t + 1] * back[:, t + 1]
            now = after @ move.T
            mass = (ahead[:, t] * now).sum(axis=1)
            expected += move * ((ahead[:, t] / mass[:, None]).T @ after)
            back[:, t] = now / now.sum(axis=1, keepdims=True)
        label = ahead * back
        label /= label.sum(axis=2, keepdims=True)
        error = (label - here).reshape(-1, width)
        by_type = np.stack([np.bincount(ids.ravel(), error[:, k], len(sizes))
                            for k in range(width)], axis=1) * scale[:, None]
        by_feature = np.stack([np.bincount(slot, by_type[owner, k], len(used))
                               for k in range(width)], axis=1)
        slope = np.concatenate((by_feature.ravel(), (expected - counted).ravel(),
                                error.reshape(CHAINS, CHAIN, width)[:, 0].sum(axis=0)))
        slope = slope / CHAINS + 1e-5 * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        theta -= 0.3 * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    model.weights[used] = theta[:shape].reshape(len(used), width)
    model.moves = theta[shape:shape + width * width].reshape(width, width)
    model.first = theta[shape + width * width:]
    return model


def learned(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf:
    """The model of a bounded sample of the labelled rows that are not held out."""

    rows = docs.select("doc_id", "text", "lang").where(
        ~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample_docs).collect()}
    if not counts:
        return Crf([], {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    each = max(1, sample_docs // len(counts))
    chance = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * each / n)))
                          for k, n in counts.items()])
    drawn = F.pmod(F.xxhash64(id_text(), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(drawn < chance).select("text", "lang", F.xxhash64(
        id_text(), "text").alias("order")).orderBy("order", "lang").limit(
        2 * sample_docs).toPandas()
    sample = sample.sort_values(["order", "lang"], kind="stable").groupby("lang").head(each)
    return fit(list(sample["text"]), list(sample["lang"]))


def identified(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    chosen = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, TEXT_BYTES):
                labels, scores = shipped.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(labels, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"])

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def switches(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, runs): where each text changes its language, as runs of words of one label.

    Words are numbered from 0; a text without a letter has no run. The probabilities whose mean
    labels the whole text are the same.
    """

    chosen = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()),
                                   ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(shipped.value.runs(part.column(1).to_pylist()),
                                              run_type)], names=["doc_id", "runs"])

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, runs array<struct<first_word: bigint, "
                                  "words: bigint, lang: string, score: double>>")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows not held out."""

    return identified(docs, learned(docs)).select("doc_id", held_out(4, 2).alias("held_out"),
                                                  "lang_pred", "score")


def stage(spark, docs: DataFrame, folder: str, least: float = 0.3) -> DataFrame:
    """Documents in a language: those without a letter, or with no likely label, go."""

    shipped = spark.sparkContext.broadcast(learned(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, place, TEXT_BYTES):
                labels, scores = shipped.value.predict(part.column(place).to_pylist())
                yield part.filter(pa.array(
                    [v != UNKNOWN and s >= least for v, s in zip(labels, scores.tolist())],
                    pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
