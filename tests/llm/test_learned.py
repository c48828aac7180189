"""Learned models: held-out accuracy, brute force and the library of the vocabulary file."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stopscan.llm import additive_quality, bloom_lm, crf_language, token_counts

FOLDER = "/root/testdata/sf0.01"


def crc(value, modulus):
    return zlib.crc32(("" if value is None else str(value)).encode()) % modulus


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = crf_language.languages(docs).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in found)
    away = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in away]) > 0.97


def test_forward_backward_matches_all_label_rows():
    rng = np.random.default_rng(0)
    model = crf_language.Crf(["a", "b", "c"], {}, np.zeros((4, 3)), rng.normal(size=(3, 3)),
                             rng.normal(size=3))
    lengths, scores = np.array([4, 2]), rng.normal(size=(6, 3))
    found = model.posteriors(scores, lengths)
    for n, (at, size) in enumerate(((0, 4), (4, 2))):
        total, mass = np.zeros(3), 0.0
        for code in range(3 ** size):
            row = [code // 3 ** k % 3 for k in range(size)]
            weight = math.exp(model.first[row[0]] + sum(scores[at + k, v] for k, v in enumerate(
                row)) + sum(model.moves[a, b] for a, b in zip(row, row[1:])))
            mass += weight
            for v in row:
                total[v] += weight / size
        assert np.allclose(found[n], total / mass)


def test_code_switched_words_get_their_own_label(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = crf_language.learned(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 2000").collect()}
    words = [crf_language.LETTERS.findall(by[v].lower())[:30] for v in ("en", "de")]
    mixed = " ".join(words[0] + words[1])
    label, score = model.predict([mixed])
    assert label[0] in ("en", "de") and 0.3 < score[0] < 0.75


def test_a_switch_is_found_at_its_word(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    by = {r.lang: r.text for r in docs.where("n_chars > 2000").collect()}
    words = [crf_language.LETTERS.findall(by[v].lower())[:30] for v in ("en", "de")]
    rows = [(1, " ".join(words[0] + words[1])), (2, None), (3, "12 !"), (4, " ".join(words[1]))]
    found = {r.doc_id: [x.asDict() for x in r.runs] for r in crf_language.switches(
        spark.createDataFrame(rows, "doc_id long, text string"), crf_language.learned(docs)).collect()}
    assert found[2] == found[3] == [] and [x["lang"] for x in found[4]] == ["de"]
    assert [x["lang"] for x in found[1]] == ["en", "de"]
    assert abs(found[1][1]["first_word"] - 30) <= 2
    assert sum(x["words"] for x in found[1]) == 60


def test_a_language_of_short_texts_only_is_learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang in ('en', 'fr', 'de')")
    rows = docs.select("doc_id", "text", "lang").collect()
    cut = [(r.doc_id, " ".join(r.text.split()[:6]) if r.lang == "de" else r.text, r.lang)
           for r in rows if r.text]
    found = crf_language.languages(spark.createDataFrame(
        cut, "doc_id long, text string, lang string")).where("held_out").collect()
    short = {k for k, t, v in cut if v == "de" and len(crf_language.LETTERS.findall(t)) > 4}
    told = [r.lang_pred for r in found if r.doc_id in short]
    assert len(told) > 10 and np.mean([v == "de" for v in told]) > 0.9


def test_languages_of_odd_rows(spark, odd, empty):
    found = {r.doc_id: r for r in crf_language.languages(odd).collect()}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1, 2, 3, 7))
    assert found[4].lang_pred in ("en", "fr")
    assert crf_language.languages(empty).count() == 0
    kept = crf_language.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {4, 5, 8, None}


def test_token_counts_match_the_library(spark, documents, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), token_counts.Merger(path)
    texts = ["", "  ", "aaaaaaa", "<|startoftext|>Hi<|endoftext|>", "don't I'LL 'S'ſ", "ΑΣ ΣΑΣ",
             "İstanbul ǅ ﬀ ẞ", "été", "漢字かな😀😀", "1234 5a6 x y",
             "nd" * 300, "<|STARTOFTEXT|>", "\x00�"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine.count(texts) == want
    for table in (documents, odd):
        rows = table.select("doc_id", "text").collect()
        want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(
            r.text or "", add_special_tokens=False).ids)) for r in rows)
        found = token_counts.counted(table, "word_bpe_49k.json").collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    assert token_counts.counted(empty, "word_bpe_49k.json").count() == 0


def test_the_filter_returns_quantised_counts():
    keys = np.arange(5000) * 7
    counts = np.random.default_rng(0).geometric(0.01, 5000)
    part = bloom_lm.LogFilter.part_of(keys)
    size = 64 * 400
    bits = np.zeros((bloom_lm.PARTS, size // 8), np.uint8)
    for p in range(bloom_lm.PARTS):
        bits[p] = bloom_lm.LogFilter.filled(keys[part == p], counts[part == p], size)
    found = bloom_lm.LogFilter(bits)
    levels, want = found.levels(keys), np.log2(counts).astype(int) + 1
    assert (levels >= want).all() and (levels == want).mean() > 0.99
    assert (found.levels(np.arange(5000) * 7 + 3) > 0).mean() < 0.01


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w] + [""]


def test_base_scores_match_brute_force(spark, documents, odd, empty, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD_WORDS", 500)
    monkeypatch.setattr(bloom_lm, "CLASSES", 50)
    for table in (documents, odd):
        rows = table.select("doc_id", "text").collect()
        counts = Counter(t for r in rows if crc(r.doc_id, 7) != 2 for t in tokens(r.text))
        n, v = sum(counts.values()), len(counts)
        want = Counter()
        for r in rows:
            row = tokens(r.text)
            base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in row)
            want[r.doc_id, len(row), sum(t in counts for t in row), round(base, 4)] += 1
        found = bloom_lm.scored(table).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4))
                       for r in found) == want
        assert {r.train_tokens for r in found} == {n} and all(r.score < 0 for r in found)
    assert bloom_lm.scored(empty).count() == 0


def test_class_probabilities_add_up(spark, documents, monkeypatch):
    monkeypatch.setattr(bloom_lm, "CLASSES", 20)
    model, _ = bloom_lm.learned(documents)
    width = model.classes + 1
    for before in (0, 3, model.classes):
        p = 10 ** model.class_scores(before * width + np.arange(width))
        assert abs(p.sum() - 1) < 0.02


def test_quality_held_out(spark, odd, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = additive_quality.quality(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) for r in found)
    assert all(r.predicted == (r.score >= 0.5) for r in found)
    away = [r for r in found if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in away]) > 0.95
    few = spark.createDataFrame([(4, 1), (5, None), (99, 0), (None, 1)],
                                "doc_id bigint, quality int")
    assert additive_quality.quality(odd, few).count() == 10
    assert additive_quality.quality(odd, few.limit(0)).where("score = 0.5").count() == 10
    assert additive_quality.quality(empty, few).count() == 0


def test_tables_learn_an_interaction():
    rng = np.random.default_rng(4)
    x = np.zeros((4000, 14))
    x[:, :3] = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = additive_quality.Additive(14).fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.85


@pytest.mark.parametrize("head", [12, 500])
def test_pairs_of_rare_words_have_counts_of_their_own(spark, monkeypatch, head):
    """Scores equal the formula over exact counts, quantised; a phrase seen often beats its words apart."""

    monkeypatch.setattr(bloom_lm, "HEAD_WORDS", head)
    monkeypatch.setattr(bloom_lm, "CLASSES", 8)
    monkeypatch.setattr(bloom_lm, "PAIRS_PER_PART", 64)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(x), 60)}" for x in draw.geometric(0.08, 30)) for _ in range(150)]
    texts += ["amber falcon harbour"] * 40 + ["falcon w1", "harbour w2", "w1 amber"] * 13
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = ["amber falcon harbour", "harbour amber falcon", "unseen falcon w1", "w1 w2 w3", "", *texts[:20]]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in bloom_lm.scores(docs, train).collect()}
    model, _ = bloom_lm.learned(train)
    words, pairs = Counter(), Counter()
    for text in texts:
        row = ["", *tokens(text)]
        words.update(row[1:])
        pairs.update(zip(row, row[1:]))

    def quantised(c):
        return float(bloom_lm.count_at(np.array([int(math.log2(c)) + 1 if c else 0]))[0])

    ids = {w: n for n, w in enumerate(model.words.to_pylist()[:model.classes])}
    width, rare = model.classes + 1, model.classes
    for n, text in enumerate(asked):
        score, row = 0.0, ["", *tokens(text)]
        for b, w in zip(row, row[1:]):
            one, two = ids.get(b.encode(), rare), ids.get(w.encode(), rare)
            group = 10 ** float(model.class_scores(np.array([one * width + two]))[0])
            inner = (words[w] + 1) / model.rare if two == rare else 1.0
            if one < rare:
                z = quantised(sum(c for (x, y), c in pairs.items()
                                  if x == b and y.encode() not in ids))
                p = group * (inner if two < rare else (
                    quantised(pairs[b, w]) + bloom_lm.PRIOR * inner) / (z + bloom_lm.PRIOR))
            else:
                p = (quantised(pairs[b, w]) + bloom_lm.PRIOR * group * inner) / (
                    words[b] + bloom_lm.PRIOR)
            score += math.log10(p)
        assert found[n] == pytest.approx(score, abs=0.02 * len(row))
    assert found[0] > found[1] + 0.5
