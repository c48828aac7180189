"""Toxicity by maximum-scoring segments of a text's words.

Every word carries a score: the log of its odds in toxic against clean text, with a Dirichlet prior
in proportion to its frequency in all labelled text, drawn towards zero by `CAUTION` standard
deviations and lowered by `DRIFT`. The k-th occurrence of a word in a text counts a k-th of its
score, for words come in bursts. A linear scan finds all maximal segments of a text: stretches
whose total no extension and no part betters. Scores of clean text drift downwards, so the best
segment of `m` clean words follows an extreme-value law: a total S comes up `K m exp(-rate S)` times
by chance. `rate` solves `sum p exp(rate s) = 1` over the words of clean text, and K makes the mean
of the law that of the clean training texts. A document's evidence is the sum over its segments of
`rate S - ln(K m)` where that is positive; a logistic curve turns it into the score.

Learning reads every labelled row that is not held out. Words are counted by Spark; those with at
least one in `VOCABULARY` of all toxic words get their own score, which are `VOCABULARY` at most,
whatever the size of the corpus, and all others score `-DRIFT`. Calibration is cross-fitted: a
training text is scored by the words of the other half of the training rows, so no text is judged by
counts of its own. Prediction reads whole texts.

Defined results: words are runs of letters, digits and marks, lower-cased. A null or empty text has no
evidence, which is the least score. Null labels and labels of absent ids teach nothing; an id with two
labels counts as toxic if any of its labels is. A repeated row gets its own equal result, a null id is
never labelled. Without both a toxic and a clean training row, every score is 0. An empty table gives
an empty result. Only doc_id and text are read from the documents, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import byte_slices, held_out, id_text, if_small, settle

VOCABULARY = 1 << 18
PRIOR_TOKENS = 50_000.0
CAUTION = 2.0
DRIFT = 0.03
CUT = 0.3
#: A passage is reported where chance brings as good a one in a clean text at most this often.
CHANCE = 0.01
#: Evidence is calibrated in so many steps of a quarter.
STEPS = 400
EULER = 0.5772156649015329
WORDS = re.compile(r"\w+")
#: Partial word counts are handed on when a task holds so many different words.
HELD_WORDS = 200_000
TEXT_BYTES = 8 << 20
#: Bytes of one id and label in a broadcast table.
LABEL_BYTES = 40


def word_scores(toxic: np.ndarray, clean: np.ndarray, all_toxic: float,
                all_clean: float) -> np.ndarray:
    """Shrunken log-odds of each word, less the drift."""

    # Half an occurrence more, for words that one half of the training rows lacks.
    share = (toxic + clean + 0.5) / (all_toxic + all_clean + 1)
    a, b = toxic + PRIOR_TOKENS * share, clean + PRIOR_TOKENS * share
    odds = (np.log(a / (all_toxic + PRIOR_TOKENS - a)) - np.log(b / (all_clean + PRIOR_TOKENS - b)))
    doubt = CAUTION * np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(0, np.abs(odds) - doubt) - DRIFT


def decay_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of `sum p exp(rate s) = 1`, or 1 where the scores do not drift down."""

    p = weights / weights.sum()
    if p @ scores >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while p @ np.exp(np.minimum(high * scores, 700)) < 1:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(middle * scores) < 1 else (low, middle)
    return high


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, total) of every maximal segment, left to right, in linear time.

    A stretch is left open while its start has a lower running total than all that came before it
    in the list; one that reaches a higher total joins all stretches back to the nearest lower start.
    """

    total = np.concatenate(([0.0], np.cumsum(scores)))
    rises = np.flatnonzero(scores > 0)
    if not len(rises):
        return []
    # Neighbouring rises always belong together.
    breaks = np.flatnonzero(np.diff(rises) > 1) + 1
    firsts = rises[np.concatenate(([0], breaks))]
    ends = rises[np.concatenate((breaks - 1, [len(rises) - 1]))] + 1
    found: list[tuple[int, int, float, float, int]] = []  # first, end, left, right, nearest lower
    for first, end in zip(firsts.tolist(), ends.tolist()):
        left, right = total[first], total[end]
        back = len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= left:
                back = found[back][4]
            if back < 0 or found[back][3] >= right:
                found.append((first, end, left, right, back))
                break
            first, left, back_of = found[back][0], found[back][2], found[back][4]
            del found[back:]
            back = back_of
    return [(a, b, float(r - low)) for a, b, low, r, _ in found]


class Segments:
    """The scores of the listed words, the constants of the extreme-value law, and the curve."""

    def __init__(self, scores: dict[str, float], rate: float = 1.0, log_k: float = 0.0,
                 curve: tuple[float, float] | None = None) -> None:
        self.scores, self.rate, self.log_k, self.curve = scores, rate, log_k, curve

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORDS.findall(text.lower()) if text else []
        get = self.scores.get
        scores = np.fromiter((get(w, -DRIFT) for w in words), np.float64, len(words))
        seen: Counter = Counter()
        for at in np.flatnonzero(scores > 0).tolist():
            seen[words[at]] += 1
            scores[at] /= seen[words[at]]
        return len(words), maximal_segments(scores)

    def evidence(self, text: str | None) -> float:
        size, found = self.scan(text)
        floor = self.log_k + math.log(max(size, 1))
        return sum(max(0.0, self.rate * s - floor) for _, _, s in found)

    def probability(self, text: str | None) -> float:
        if self.curve is None:
            return 0.0
        level, slope = self.curve
        x = level + slope * min(self.evidence(text), STEPS / 4)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half) of the training rows."""

    marks, _ = settle(labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(
        F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic")), "toxic-labels")
    # Ids and labels travel to the texts where their counted size allows; else both are shuffled.
    marks = if_small(marks, marks.count(), LABEL_BYTES)
    rows = docs.select("doc_id", "text").where(~held_out(4, 2))
    half = F.pmod(F.xxhash64(id_text(), F.lit("half")), F.lit(2)).cast("int")
    return rows.join(marks, F.col("doc_id") == F.col("__id")).select(
        "text", (F.col("toxic") > 0).alias("toxic"), half.alias("half"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c0..c3): texts that hold it, clean and toxic of the first half, then of the second.

    A text counts a word once, so that one text that repeats a word does not make it toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(4)]

        def flush() -> pa.RecordBatch:
            words = list(dict.fromkeys(w for c in held for w in c))
            columns = [pa.array(words, pa.string())] + [
                pa.array([c[w] for w in words], pa.int64()) for c in held]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "c0", "c1", "c2", "c3"])

        for batch in batches:
            for part in byte_slices(batch, 0, TEXT_BYTES):
                for text, toxic, half in zip(*[c.to_pylist() for c in part.columns]):
                    if text:
                        held[2 * half + toxic].update(set(WORDS.findall(text.lower())))
                if sum(map(len, held)) > HELD_WORDS:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "word string, c0 bigint, c1 bigint, c2 bigint, c3 bigint").groupBy(
        "word").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)])


def _law(words: list[str], clean: np.ndarray, toxic: np.ndarray, all_clean: float,
         all_toxic: float) -> Segments:
    scores = word_scores(toxic, clean, all_toxic, all_clean)
    rest = max(all_clean - clean.sum(), 1.0)
    share = PRIOR_TOKENS * (toxic + clean) / (all_toxic + all_clean)
    rate = decay_rate(np.append(scores, -DRIFT), np.append(clean + share, rest))
    return Segments({w: s for w, s in zip(words, scores.tolist()) if s != -DRIFT}, rate)


def _fitted_curve(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Level and slope of the logistic curve by Newton steps; one pseudo-row at either end keeps it
    finite where evidence parts the labels wholly."""

    at = np.array([0.0, STEPS / 4] + [k / 4 for k, _, _ in bins])
    toxic = np.array([0.0, 1.0] + [t for _, t, _ in bins])
    rows = np.array([1.0, 1.0] + [n for _, _, n in bins])
    beta = np.zeros(2)
    x = np.stack((np.ones_like(at), at), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (toxic - rows * p) - 1e-3 * beta
        bend = (x * (rows * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def learned(docs: DataFrame, labels: DataFrame) -> Segments:
    """Word scores and constants from all training rows."""

    spark = docs.sparkSession
    rows = labelled(docs, labels)
    counts, _ = settle(word_counts(rows), "toxic-words")
    totals = counts.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(4)]).first()
    c = [float(totals[k] or 0) for k in range(4)]
    if not c[0] + c[2] or not c[1] + c[3]:
        return Segments({})
    frequent = counts.where((F.col("c1") + F.col("c3")) * VOCABULARY >= c[1] + c[3]).toPandas()
    frequent = frequent.sort_values("word", kind="stable")
    words = frequent["word"].tolist()
    n = [frequent[f"c{k}"].to_numpy(float) for k in range(4)]
    whole = _law(words, n[0] + n[2], n[1] + n[3], c[0] + c[2], c[1] + c[3])
    # Words of one half judge the texts of the other.
    halves = [_law(words, n[2 - 2 * h], n[3 - 2 * h], max(c[2 - 2 * h], 1.0),
                   max(c[3 - 2 * h], 1.0)) for h in (0, 1)]
    shipped = spark.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0, TEXT_BYTES):
                sizes, scaled = [], []
                for text, half in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    model = shipped.value[half]
                    size, found = model.scan(text)
                    sizes.append(size)
                    scaled.append([model.rate * s for _, _, s in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(sizes, pa.int64()),
                     pa.array(scaled, pa.list_(pa.float64()))], names=["toxic", "m", "scaled"])

    judged, _ = settle(rows.mapInArrow(run, "toxic boolean, m bigint, scaled array<double>"),
                       "toxic-segments")
    best = F.array_max("scaled") - F.log("m")
    mean = judged.where("NOT toxic AND size(scaled) > 0").agg(F.avg(best)).first()[0]
    whole.log_k = (mean or 0.0) - EULER
    over = _evidence(whole.log_k)
    bins = judged.groupBy(F.least(F.floor(over * 4), F.lit(STEPS)).cast("int").alias("bin")).agg(
        F.sum(F.col("toxic").cast("int")).alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    whole.curve = _fitted_curve([(r["bin"], r["toxic"], r["n"]) for r in bins])
    return whole


def _evidence(log_k: float) -> Column:
    floor = F.lit(log_k) + F.log(F.greatest(F.col("m"), F.lit(1)))
    return F.aggregate("scaled", F.lit(0.0), lambda sum_, s: sum_ + F.greatest(
        F.lit(0.0), s - floor))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    chosen = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1, TEXT_BYTES):
                found = [shipped.value.probability(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(4, 2).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))


def passages(docs: DataFrame, model: Segments, chance: float = CHANCE) -> DataFrame:
    """(doc_id, first_word, n_words, begin, length, total, by_chance, passage) of every significant
    toxic passage; `begin` and `length` count characters of the text."""

    chosen = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "first_word", "n_words", "begin", "length", "total", "by_chance", "passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law = shipped.value
        for batch in batches:
            for part in byte_slices(batch, 1, TEXT_BYTES):
                rows = []
                for at, text in enumerate(part.column(1).to_pylist()):
                    # Lower-casing may lengthen a text, so places are those of the lower-cased one.
                    size, found = law.scan(text)
                    likely = [(a, b, s, math.exp(min(700.0, law.log_k + math.log(size)
                                                     - law.rate * s))) for a, b, s in found]
                    likely = [x for x in likely if x[3] <= chance]
                    if likely:
                        lower = text.lower()
                        spans = [m.span() for m in WORDS.finditer(lower)]
                        rows += [(at, a, b - a, spans[a][0], spans[b - 1][1] - spans[a][0], s, e,
                                  lower[spans[a][0]:spans[b - 1][1]]) for a, b, s, e in likely]
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(columns[0], pa.int64()))] + [
                        pa.array(c, k) for c, k in zip(columns[1:], kinds)], names=names)

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, first_word bigint, n_words bigint, begin bigint, "
                                  "length bigint, total double, by_chance double, passage string")
