"""Decontamination, near and exact duplicates against brute force."""

import hashlib
import re
import tempfile
from itertools import combinations

import numpy as np
import pytest
import xxhash

from stopscan.llm import cuckoo_dedup, decontamination, shingle_similarity, simhash
from stopscan.llm.common import attach_groups, components


def test_the_mask_hits_every_window_with_two_substitutions():
    mask, window = decontamination.MASKS[0], decontamination.WINDOW
    kept = [k for k, c in enumerate(mask) if c == "1"]
    for gone in combinations(range(window), decontamination.SUBSTITUTIONS):
        assert any(not {s + k for k in kept} & set(gone)
                   for s in range(window - len(mask) + 1))


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def leaks(docs, items):
    found = set()
    for d, text in docs:
        row = tokens(text)
        for i, passage in items:
            item = tokens(passage)
            need = min(13, len(item))
            if need < 8:
                continue
            allowed = 2 if len(item) >= 13 else 0
            for shift in range(-len(item), len(row)):
                lo, hi = max(0, -shift), min(len(item), len(row) - shift)
                same = [row[k + shift] == item[k] for k in range(lo, hi)]
                if any(sum(same[k:k + need]) >= need - allowed
                       for k in range(len(same) - need + 1)):
                    found.add((d, i))
    return found


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(40)}"
    items = [(n, " ".join(word() for _ in range(length)))
             for n, length in enumerate((5, 8, 12, 13, 20, 40))]
    items += [(90, None), (91, ""), (None, " ".join(f"z{k}" for k in range(20)))]
    docs = []
    for n in range(60):
        row = [word() for _ in range(rng.integers(0, 80))]
        item = tokens(items[n % 6][1])
        for k in rng.choice(len(item), size=n % 4, replace=False):
            item[k] = "other"
        at = int(rng.integers(0, len(row) + 1))
        docs.append((n, " ".join(row[:at] + item + row[at:]).upper().replace(" ", ", ")))
    docs += [(70, None), (71, ""), (None, "Z0 " + " ".join(f"z{k}" for k in range(20))),
             (3, docs[3][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr(
        "*", "1 AS h", "2 AS known", "3 AS item_id")
    found = decontamination.contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks(docs, items)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})
    two = decontamination.contaminated(frame, benchmark, masks=("11110011", "11010111"))
    assert {(r.doc_id, r.item_id) for r in two.collect()} == leaks(docs, items)


def test_leaks_of_odd_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta alpha beta")],
                                  "item_id bigint, text string")
    found = decontamination.contaminated(odd, items).collect()
    assert {r.doc_id for r in found} == {4, 5}
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0


def reference_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    rows = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 254, 258, 259, 700):
        text = " ".join(rng.choice(["the", "of", "Ébc", "xy\x0b", "Qu"], n))
        assert simhash.fingerprint(text) == reference_print(text)


def test_every_link_shares_a_key():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    for value in values:
        errors = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        pair = np.array([value, value ^ np.uint64(errors)], np.uint64)
        keys, owners = simhash.keys_of(pair)
        assert set(keys[owners == 0]) & set(keys[owners == 1])


def brute_components(prints):
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(prints)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(prints))]


def test_components_match_brute_force(spark, documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    roots = brute_components([reference_print(r.text) for r in rows])
    found = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    for row, root in zip(rows, roots):
        assert found[row.doc_id].component_id == rows[root].doc_id
        assert found[row.doc_id].fingerprint == f"{reference_print(row.text):016x}"


def test_crowded_buckets_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(5)
    values = {0x0123456789ABCDEF}
    for _ in range(60):
        values.add(int(rng.choice(list(values))) ^ (1 << int(rng.integers(64))))
    values |= {int(v) for v in rng.integers(0, 2**62, 40)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "bits bigint")
    links = simhash.links_in_buckets(distinct)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
    joined = {r.node: r.root for r in components(links).collect()}
    groups = {}
    for value, root in zip(signed, brute_components(values)):
        groups.setdefault(root, set()).add(value)
    found = {}
    for value in signed:
        found.setdefault(joined.get(value, value), set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 10
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert [by_id[k].component_id for k in (1, 2, 3, 4, 5)] == [1, 1, 1, 4, 4]
    assert by_id[1].fingerprint == "0" * 16
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.stage(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 7, 8]
    assert kept.where("doc_id is null").count() == 1
    assert simhash.stage(spark, empty, "").count() == 0


def test_stages_decide_by_row_where_ids_repeat(spark):
    one, two, three = (" ".join(f"{k}{n}" for n in range(40)) for k in "abc")
    rows = [(5, one, "x"), (5, two, "x"), (7, two, "x"), (1, one, "x"), (9, three, "x"),
            (9, three, "x"), (9, three, "y"), (None, two, "x"), (None, three + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.stage(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, one), (5, two), (9, three)]
    folder = f"{tempfile.mkdtemp()}"
    spark.createDataFrame([(1, two)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    clean = decontamination.stage(spark, docs, folder).collect()
    assert sorted(map(tuple, clean), key=str) == sorted((r for r in rows if r[1] != two), key=str)


def test_short_items_match_whole_documents_only(spark):
    docs = [(1, "What is, two plus two"), (2, "well what is two plus two"), (3, "ONE"), (4, None),
            (1, "What is two plus two?"), (5, "")]
    items = [(1, "what is two plus two?"), (2, "one"), (3, "!"), (4, None)]
    found = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 5, 5), (3, 2, 1, 1)]


def test_the_stage_links_texts_from_four_fifths_similarity(spark, monkeypatch):
    """Components are those of all pairs at 0.8; with small blocks, too."""

    def sets(text):
        words = text.split()
        return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}

    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        words = [f"w{n}" for n in rng.integers(0, 3000, 200)]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 4, 5, 6):
            copy = list(words)
            for at in rng.choice(200, changes, replace=False):
                copy[at] = "changed"
            texts.append(" ".join(copy))
    found = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if 10 * len(found[a] & found[b]) >= 8 * len(found[a] | found[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {k for k in range(len(texts)) if find(k) == k}
    assert 40 <= len(want) < len(texts) / 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.stage(spark, docs, "").collect()} == want
    monkeypatch.setattr(shingle_similarity, "CROWD", 4)
    groups = shingle_similarity.similar_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in groups} == {
        k: find(k) for k in range(len(texts))}


def test_long_chains_and_stars_become_components(spark):
    edges = [(n, n + 1) for n in range(200)] + [(1000, 1000 + k) for k in range(1, 300)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(found) == 501
    assert all(r.root == (0 if r.node <= 200 else 1000) for r in found)


def test_hot_groups_keep_every_row(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "IF(id < 4000, 'hot', CAST(id % 500 AS "
                                        "string)) AS k")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    found = attach_groups(rows, groups, "k", "n", 6000, rows.doc_id)
    assert found.where("n is null").count() == 0
    assert found.where("n = 4000").count() == 4000


def test_exact_duplicates(odd, empty):
    found = cuckoo_dedup.exact_duplicates(odd).collect()
    assert len(found) == 10
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[1].kept) == (2, 2, False)
    assert by_id[2].kept and by_id[4].keep_id == 5 and by_id[4].group_size == 3
    assert by_id[1].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(r.kept for r in found if r.doc_id is None)
    assert cuckoo_dedup.exact_duplicates(empty).count() == 0


def test_large_ids_beside_nulls_keep_every_digit(spark):
    rows = [(2 ** 53 + 1, "x"), (None, "y"), (2 ** 53, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {(r.doc_id, r.text_sha256[:4]): r for r in cuckoo_dedup.exact_duplicates(docs).collect()}
    x = hashlib.sha256(b"x").hexdigest()[:4]
    assert {r.keep_id for k, r in found.items() if k[1] == x} == {2 ** 53 + 1}
    assert found[2 ** 53 + 1, x].kept and not found[2 ** 53, x].kept and not found[None, x].kept


def test_a_hot_text_reaches_the_index_once(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CAST(id AS string)) AS text")
    added = cuckoo_dedup.insertions(cuckoo_dedup.digests(docs.repartition(16)))
    assert added.count() == 6001 and added.where("group_size = 3000 AND keep_id = 8997").count() == 1
    assert cuckoo_dedup.exact_duplicates(docs).where("group_size = 3000").count() == 3000


def test_the_index_inserts_deletes_and_resizes(spark):
    index = cuckoo_dedup.CuckooFilter(1)
    names = [hashlib.sha256(str(n).encode()).hexdigest() for n in range(3000)]
    before = index.buckets
    numbers = [index.insert(n) for n in names]
    assert index.buckets > before
    assert [index.find(n) for n in names] == numbers
    assert index.find("f" * 64) == -1
    assert all(index.delete(n) for n in names[::2])
    assert not index.delete(names[0])
    assert [index.find(n) for n in names[:4]] == [-1, 1, -1, 3]
    row = lambda ids: spark.createDataFrame(
        [(names[n], n, 1) for n in ids], "digest string, keep_id bigint, group_size bigint")
    first = cuckoo_dedup.updated(None, row([0, 1, 2]))
    then = cuckoo_dedup.updated(first, row([2, 3]), row([0]).select("digest"))
    assert sorted((r.keep_id, r.group_size) for r in then.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_the_stage_compares_what_fingerprints_link(spark, monkeypatch):
    """Without any band, copies that fingerprints link are still checked and found."""

    words = [f"w{n}" for n in range(300)]
    phrase = "one two three four five " * 200
    texts = [" ".join(words), " ".join([*words, "more"]), "apart from both",
             *[phrase + " ".join(f"{k}{n}" for n in range(20)) for k in "ab"]]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert (prints[2], prints[5]) == (1, 4)
    monkeypatch.setattr(shingle_similarity, "ROUNDS", ())
    # The last two are linked by their phrase, but most of their shingles differ.
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("length", [3, 24, 150])
def test_links_need_no_band(spark, monkeypatch, length):
    """Without any band, components are still those of all pairs at 0.8, beside lines that many share."""

    rng = np.random.default_rng(length)
    line, texts = " all of us share this line of words", []
    for _ in range(25):
        words = [f"w{n}" for n in rng.integers(0, 3000, length)]
        for changes in (0, 1, 2, 4):
            copy = list(words)
            for at in rng.choice(length, min(changes, length - 1), replace=False):
                copy[at] = f"c{rng.integers(0, 9)}"
            texts.append(" ".join(copy) + line * (len(texts) % 3 == 0))
    found = [set(shingle_similarity.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if 10 * len(found[a] & found[b]) >= 8 * len(found[a] | found[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(shingle_similarity, "ROUNDS", ())
    groups = shingle_similarity.similar_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in groups} == {k: find(k) for k in range(len(texts))}
    assert len({r.component_id for r in groups}) < len(texts) or length == 3
