"""Maximal segments against their definition, the extreme-value law, and held-out labels."""

import zlib

import numpy as np
import pytest

from stopscan.llm import toxic_segments
from stopscan.llm.toxic_segments import Segments, decay_rate, maximal_segments


def by_definition(scores, start=0):
    """The best stretch (shortest of equals), then those of what lies left and right of it."""

    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = sum(scores[a:b])
            if total > 0 and (best is None or (total, a - b) > (best[2], best[0] - best[1])):
                best = (a, b, total)
    if best is None:
        return []
    a, b, total = best
    return (by_definition(scores[:a], start) + [(start + a, start + b, total)]
            + by_definition(scores[b:], start + b))


def test_all_maximal_segments_are_found():
    rng = np.random.default_rng(0)
    for size in list(range(12)) * 20:
        scores = rng.normal(-0.2, 1, size)
        found = maximal_segments(scores)
        want = by_definition(scores.tolist())
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in found], [s for _, _, s in want])


def test_the_rate_solves_its_equation():
    scores, weights = np.array([3.0, 1.0, -0.5]), np.array([2.0, 3.0, 95.0])
    rate = decay_rate(scores, weights)
    assert rate > 0 and abs((weights / 100) @ np.exp(rate * scores) - 1) < 1e-9
    assert decay_rate(np.array([1.0]), np.array([1.0])) == 1.0


def test_passages_are_cut_out_whole(spark, odd, empty):
    law = Segments({"idiot": 4.0, "scum": 3.0}, rate=2.0, log_k=-2.0, curve=(-3.0, 1.0))
    text = "Well " * 200 + "you idiot, you SCUM! " + "fine " * 300 + "idiot scum idiot"
    docs = spark.createDataFrame([(1, text, "x"), (2, "a well", "x"), (3, None, "x"), (None, "", "x")],
                                 "doc_id bigint, text string, total string")
    found = toxic_segments.passages(docs, law).orderBy("first_word").collect()
    assert [r.passage for r in found] == ["idiot, you scum", "idiot scum idiot"]
    assert [text.lower()[r.begin:r.begin + r.length] for r in found] == [r.passage for r in found]
    assert all(r.doc_id == 1 and r.by_chance <= toxic_segments.CHANCE for r in found)
    assert toxic_segments.passages(odd, law).count() == 0
    assert toxic_segments.passages(empty, law).count() == 0
    # The scan by hand: the second time, a word counts half.
    size, segments = law.scan("idiot well idiot")
    assert size == 3 and segments == [(0, 3, pytest.approx(4.0 - toxic_segments.DRIFT + 2.0))]


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxic_segments.scored(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    away = [r for r in found if r.held_out and r.doc_id in truth]
    caught = np.mean([r.predicted for r in away if truth[r.doc_id]])
    false = np.mean([r.predicted for r in away if not truth[r.doc_id]])
    assert caught > 0.85 and false < 0.04
    # A model that knows only how many are toxic.
    share = np.mean([truth[r.doc_id] for r in away])
    assert np.mean([(r.score - truth[r.doc_id]) ** 2 for r in away]) < 0.35 * share * (1 - share)


def test_word_scores_match_the_formula(spark):
    rows = [(n, ("bad word " if n % 2 else "good word ") * (n + 1)) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, n % 2) for n, _ in rows], "doc_id bigint, toxic int")
    model = toxic_segments.learned(docs, labels)
    kept = [n for n, _ in rows if zlib.crc32(str(n).encode()) % 4 != 2]
    t, c = sum(n % 2 for n in kept), sum(1 - n % 2 for n in kept)
    total_t, total_c = 2 * t, 2 * c
    prior = toxic_segments.PRIOR_TOKENS * (t + 0.5) / (total_t + total_c + 1)
    a, b = t + prior, prior
    whole = toxic_segments.PRIOR_TOKENS
    odds = np.log(a / (total_t + whole - a)) - np.log(b / (total_c + whole - b))
    doubt = toxic_segments.CAUTION * np.sqrt(1 / a + 1 / b)
    assert model.scores.get("bad", -toxic_segments.DRIFT) == pytest.approx(
        np.sign(odds) * max(0, abs(odds) - doubt) - toxic_segments.DRIFT)


def test_toxicity_of_odd_rows(spark, odd, empty):
    few = spark.createDataFrame([(4, 1), (5, None), (99, 0), (None, 1), (8, 0), (8, 1), (1, 0)],
                                "doc_id bigint, toxic int")
    for labels in (few, few.limit(0), few.where("toxic = 0")):
        assert toxic_segments.scored(odd, labels).count() == 10
    assert toxic_segments.scored(odd, few.limit(0)).where("score = 0 AND predicted = 0").count() == 10
    assert toxic_segments.scored(empty, few).count() == 0
