"""Token counts by rank-synchronous merging of ragged symbol arrays.

A text is normalised and cut into pre-tokens as the vocabulary file's library does it. Pre-tokens
not met before are laid out as one flat array of symbols with sequence boundaries. In each round
every sequence finds its lowest-ranked adjacent pair and applies it at once wherever it stands in
that sequence (in a run of one symbol, from the left); sequences without a ranked pair are done and
leave. What survives is counted. Counts of pre-tokens are remembered per task.

Defined results: a null text counts as empty, with no bytes and no tokens. The vocabulary's special
strings inside a text count as one token each, as the library does by default. Texts are read
whole. Repeated rows get the same count; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

LIMIT = 2048
CACHE_WORDS = 400_000
BATCH_WORDS = 20_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    stands = dict(zip(plain, plain)) | {b: 256 + n for n, b in enumerate(rest)}
    return [chr(stands[b]) for b in range(256)]


class Merger:
    """A byte-pair vocabulary with word ends, read from its file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.into = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        end = told["model"]["end_of_word_suffix"] or ""
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocabulary[c + end] for c in byte_symbols()], np.int64)
        split = next(p for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in told["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.counts: dict[str, int] = {}

    def merged(self, words: list[str]) -> np.ndarray:
        """How many symbols each pre-token ends with."""

        coded = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        counts = sizes.copy()
        while len(symbols) > 1:
            key = symbols[:-1] << 20 | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            none = len(self.ranks)
            rank = np.where((self.keys[place] == key) & (owner[:-1] == owner[1:]),
                            self.ranks[place], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(owner)))
            chosen = (rank == np.repeat(lowest, span)) & (rank < none)
            at = np.flatnonzero(chosen)
            if not len(at):
                break
            # Overlapping places lie in runs; every second place of a run is taken.
            fresh = np.append(True, np.diff(at) > 1)
            run = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
            symbols[at] = self.into[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            keep &= np.repeat(lowest < none, span)
            counts -= np.bincount(owner[at], minlength=len(words))
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a whole text, and how many special strings stand in it."""

        parts, found = [text], 0
        if self.special is not None and "<" in text:
            parts = self.special.split(text)
            found = len(parts) - 1
        words: list[str] = []
        for part in parts:
            if not part.isascii():
                # Case is mapped character by character, without the rule for a final sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            words += self.words.findall(part.lower())
        return words, found

    def count(self, texts: list[str | None]) -> list[int]:
        counts, totals, waiting = self.counts, [0] * len(texts), []
        fresh: dict[str, None] = {}

        def settle() -> None:
            for words, n in waiting:
                todo = [w for w in words if w not in counts]
                fresh.update(dict.fromkeys(todo))
            names = list(fresh)
            for i in range(0, len(names), BATCH_WORDS):
                block = names[i:i + BATCH_WORDS]
                counts.update(zip(block, self.merged(block).tolist()))
            for words, n in waiting:
                totals[n] += sum(map(counts.__getitem__, words))
            fresh.clear()
            waiting.clear()
            if len(counts) > CACHE_WORDS:
                counts.clear()

        held = 0
        for n, text in enumerate(texts):
            if text:
                words, totals[n] = self.pretokens(text)
                waiting.append((words, n))
                held += len(words)
                if held > 500_000:
                    settle()
                    held = 0
        settle()
        return totals


_MERGERS: dict[str, Merger] = {}


def counted(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    `vocabulary` names a file of the public tokenizers, which every executor has.
    """

    chosen = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if vocabulary not in _MERGERS:
            _MERGERS[vocabulary] = Merger(public_tokenizers.path(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = _MERGERS[vocabulary].count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()),
                 pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
