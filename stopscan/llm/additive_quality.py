"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles, and has a table with one number per bin. The
tables are learned by boosting in a cycle: feature after feature, round after round, a tree of at
most four leaves is fitted to the current residuals along that feature alone, and a small part of it
is added to the table. Then the pairs of features whose joint quadrants explain most of what is left
get two-way tables, boosted in a cycle likewise. A score is the logistic function of a sum of table
entries, so scoring looks bins up and adds.

Learning reads a bounded sample (`FIT_ROWS`) of the labelled rows; features cover whole texts.

Defined results: a null text counts as empty and is scored like any text. Null labels and labels of
unknown documents are not learned from. Repeated labels count each. With no label, or one class
only, every score is the smoothed share of label 1. An empty table gives an empty result. Only
doc_id and text are read of documents, and doc_id and quality of labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import held_out, id_text

FIT_ROWS = 20_000
BINS = 32
ROUNDS = 150
RATE = 0.1
PAIRS = 10
PAIR_BINS = 8
PAIR_ROUNDS = 60
#: Added to the curvature of a leaf.
RIDGE = 2.0

NAMES = ("log_chars", "log_words", "word_length", "upper", "digit", "mark", "symbol", "wide",
         "distinct", "commonest", "line_length", "line_repeats", "stops", "longest_word")


def features(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of NAMES."""

    raw = (text or "").encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    size, n = max(1, len(raw)), max(1, len(words))
    letters = max(1, seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum())
    counts = Counter(words)
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    symbols = sum(seen[ord(c)] for c in "#$%&*|!<>=_~^")
    stops = sum(seen[ord(c)] for c in ".,;:?")
    return [np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - seen[32]) / n,
            seen[65:91].sum() / letters, seen[48:58].sum() / size, marks / size, symbols / size,
            seen[128:].sum() / size, len(counts) / n, max(counts.values(), default=0) / n,
            np.log1p(len(raw) / len(lines)), 1 - len(set(lines)) / len(lines), stops / n,
            np.log1p(max(map(len, counts), default=0))]


def leaves(slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves along one feature's bins: the value of each bin."""

    def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + RIDGE)

    def cut(i: int, j: int) -> int | None:
        g, h = np.cumsum(slope[i:j]), np.cumsum(curve[i:j])
        if j - i < 2:
            return None
        better = gain(g[:-1], h[:-1]) + gain(g[-1] - g[:-1], h[-1] - h[:-1]) - gain(g[-1], h[-1])
        best = int(better.argmax())
        return i + best + 1 if better[best] > 1e-9 else None

    edges = [0, len(slope)]
    for _ in range(2):
        more = [cut(i, j) for i, j in zip(edges, edges[1:])]
        edges = sorted({*edges, *[m for m in more if m is not None]})
    out = np.zeros(len(slope))
    for i, j in zip(edges, edges[1:]):
        out[i:j] = slope[i:j].sum() / (curve[i:j].sum() + RIDGE)
    return out


def quadrants(slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, float]:
    """The four quadrants at the best crossing of two cuts: a value per cell, and its gain."""

    g, h = slope.cumsum(0).cumsum(1), curve.cumsum(0).cumsum(1)

    def four(a: np.ndarray) -> np.ndarray:
        low, top, left, every = a[:-1, :-1], a[:-1, -1:], a[-1:, :-1], a[-1, -1]
        return np.stack([low, top - low, left - low, every - top - left + low])

    gs, hs = four(g), four(h)
    score = (gs ** 2 / (hs + RIDGE)).sum(0)
    i, j = np.unravel_index(score.argmax(), score.shape)
    value = gs[:, i, j] / (hs[:, i, j] + RIDGE)
    out = np.empty_like(slope)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:] = value[0], value[1]
    out[i + 1:, :j + 1], out[i + 1:, j + 1:] = value[2], value[3]
    return out, float(score[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + RIDGE))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Additive:
    """An intercept, one table per feature, one per chosen pair, and the bin edges of both."""

    def __init__(self, width: int) -> None:
        self.base = 0.0
        self.edges = [np.zeros(0)] * width
        self.coarse = [np.zeros(0)] * width
        self.tables = [np.zeros(1)] * width
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not 0 < y.sum() < len(y):
            return self

        def edges(column: np.ndarray, bins: int) -> np.ndarray:
            return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))

        self.edges = [edges(c, BINS) for c in x.T]
        self.coarse = [edges(c, PAIR_BINS) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        fine = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T)]
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for table, place in zip(self.tables, fine):
                p = logistic(total)
                step = RATE * leaves(np.bincount(place, y - p, len(table)),
                                     np.bincount(place, p * (1 - p), len(table)))
                table += step
                total += step[place]
        p = logistic(total)

        def joint(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
            cell = rough[a] * shape[1] + rough[b]
            return (cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape),
                    np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape))

        useful = [k for k, e in enumerate(self.coarse) if len(e)]
        ranked = sorted(((quadrants(*joint(a, b, p)[1:])[1], a, b)
                         for a, b in combinations(useful, 2)), reverse=True)
        self.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1))
                            for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for table, (a, b) in zip(self.pair_tables, self.pairs):
                cell, slope, curve = joint(a, b, logistic(total))
                step = RATE * quadrants(slope, curve)[0]
                table += step
                total += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""

        total = np.full(len(x), self.base)
        for table, edge, column in zip(self.tables, self.edges, x.T):
            total += table[np.searchsorted(edge, column, "right")] if len(edge) else table[0]
        for table, (a, b) in zip(self.pair_tables, self.pairs):
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"),
                           np.searchsorted(self.coarse[b], x[:, b], "right")]
        return logistic(total)


def measured(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))


def learned(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """The model of a bounded sample of the labels that are not held out."""

    usable = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(
        ~held_out(3, 1) & F.col("quality").isNotNull())
    chance = min(1.0, 1.1 * fit_rows / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64(id_text(), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(drawn < chance).orderBy(F.xxhash64(id_text()), "doc_id", "y").limit(
        fit_rows)
    # At most fit_rows rows, so the texts stay where they are.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measured(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(x[:, k]) for k in range(len(NAMES))]],
                names=["y", *NAMES])

    schema = "y double, " + ", ".join(f"{n} double" for n in NAMES)
    rows = chosen.select("text", "y").mapInArrow(run, schema).limit(2 * fit_rows).toPandas()
    rows = rows.sort_values(["y", *NAMES], kind="stable").to_numpy(float)
    return Additive(len(NAMES)).fit(rows[:, 1:], (rows[:, 0] > 0).astype(float))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    chosen = docs.select("doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shipped.value.score(measured(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, learned from labels not held out."""

    return scored(docs, learned(docs, labels)).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
