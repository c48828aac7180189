"""Mixing, sharding, archives and the pipeline."""

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import pytest
import zstandard

import corpus_pipeline
from stopscan.llm import pfair_mix, slot_sharding, warc_zstd
from stopscan.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("weights", [None, {f"s{k}": k + 1.0 for k in range(7)}, {"s0": 50.0}])
def test_deviation_stays_under_one_block(spark, weights):
    docs = spark.range(7000).selectExpr("id AS doc_id", "CONCAT('s', id % 7) AS source")
    rows = pfair_mix.interleave(docs, weights, block_rows=2, cycle=50).collect()
    assert len({r.position for r in rows}) == 7000
    seen = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        seen.setdefault(r.slot, r.source)
    share = {}
    for slot in range(50):
        share[seen[slot]] = share.get(seen[slot], 0) + 1
    done = dict.fromkeys(share, 0)
    for slot in range(150):
        done[seen[slot]] = done.get(seen[slot], 0) + 1 if slot in seen else 0
        if all(s in seen for s in range(slot + 1)):
            assert all(abs(done[s] - (slot + 1) * share[s] / 50) < 1 for s in share)


def test_mixes_of_odd_rows(spark, odd, empty):
    rows = pfair_mix.interleave(odd).collect()
    assert len(rows) == 10 and len({r.position for r in rows}) == 10
    assert pfair_mix.interleave(empty).count() == 0
    staged = pfair_mix.stage(spark, odd, "")
    assert staged.columns == odd.columns and staged.count() == 10


def test_shards(spark, documents, odd, empty):
    for table in (documents, odd):
        source = table.select("doc_id", "text").collect()
        rows = slot_sharding.sharded(table).collect()
        want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 1,
                       zlib.crc32((r.text or "").encode())) for r in source)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32)
                      for r in rows) == want
        for shard in {r.shard for r in rows}:
            places = sorted(r.slot for r in rows if r.shard == shard)
            assert 0 <= shard < 16 and places == list(range(len(places)))
    assert slot_sharding.sharded(empty).count() == 0


def test_leading_stretches_of_a_staged_shard_follow_the_mix(spark, odd, empty, monkeypatch):
    """Sources of 16,000 and 4,000 rows mix as 2 to 1 until the smaller share has run out."""

    monkeypatch.setattr(slot_sharding, "STRETCH_ROWS", 3000)
    docs = spark.range(20000).selectExpr(
        "id AS doc_id", "CONCAT('text ', id) AS text", "IF(id % 5 = 0, 'small', 'large') AS source")
    place = {r.doc_id: r.position for r in pfair_mix.interleave(docs).collect()}
    rows = slot_sharding.stage(spark, docs, "").collect()
    assert len(rows) == 20000
    for shard in range(16):
        own = sorted((r.slot, r.doc_id) for r in rows if r.shard == shard)
        assert [n for n, _ in own] == list(range(len(own)))
        ids = [k for _, k in own]
        assert ids == sorted(ids, key=place.get)
        for lead in (200, 400, 600):
            small = sum(k % 5 == 0 for k in ids[:lead]) / lead
            assert abs(small - 1 / 3) < 0.12
    assert slot_sharding.stage(spark, odd, "").count() == 10
    assert slot_sharding.stage(spark, empty, "").count() == 0


def test_rebalancing_evens_bytes_and_growth_moves_slots_to_the_new_shard(spark):
    rng = np.random.default_rng(0)
    sizes = spark.createDataFrame([(k, int(v)) for k, v in enumerate(rng.pareto(2, 4096) * 1000)],
                                  "virtual_slot int, bytes bigint")
    first = slot_sharding.first_map(spark)
    second = slot_sharding.rebalanced(first, sizes)
    loads = [r[0] for r in second.join(sizes, "virtual_slot").groupBy("shard").agg(
        {"bytes": "sum"}).select("sum(bytes)").collect()]
    assert max(loads) < 1.01 * min(loads)
    moved = second.join(first.withColumnRenamed("shard", "was").drop("version"), "virtual_slot")
    assert moved.where("shard <> was").count() < 1200
    assert {r.version for r in second.select("version").distinct().collect()} == {2}
    third = slot_sharding.grown(second, 16).withColumnRenamed("shard", "to").drop("version")
    both = second.join(third, "virtual_slot").collect()
    assert all(r.to in (r.shard, 16) for r in both)
    assert abs(sum(r.to == 16 for r in both) - 4096 / 17) < 20


def test_archives_round_trip(spark, rows):
    pages = spark.createDataFrame(
        [(1, "http://a/\r\nX: y", "x" * 1200, "c"), (2, "é b", "x" * 1200, "c"),
         (2, "é b", "x" * 1200, "c"), (3, None, None, None), (4, "u", "", "c"),
         (5, "u", "short", "c"), (6, "u", "short", "c"), (None, "u", "é" * 600, "c"),
         (None, "u", "x" * 1200, "c")] + [(n, "u", f"<p>{n}</p>" * 300, "c") for n in range(10, 60)],
        "page_id bigint, url string, html string, payload string")
    listed = warc_zstd.write_archives(pages)
    assert sum(r.records for r in listed.collect()) == 59
    back = rows(warc_zstd.read_archives(listed))
    found = {}
    for r in back:
        found.setdefault(r["page"], r)
    assert found["1"]["record_type"] == "revisit" and found["1"]["refers"] == "2"
    assert found["1"]["payload_bytes"] == 1200 and found["1"]["url"] == "http://a/%0D%0AX:%20y"
    assert found["2"]["payload"] == b"x" * 1200 and found["3"]["payload"] == b""
    assert found["5"]["record_type"] == found["6"]["record_type"] == "response"
    assert sorted(r["record_type"] for r in back if r["page"] is None) == ["response", "revisit"]
    assert warc_zstd.round_trip(pages.limit(0)).count() == 0


def archive(*records, dictionary=b"some dictionary text"):
    pack = zstandard.ZstdCompressor(dict_data=warc_zstd.as_dictionary(dictionary))
    return struct.pack("<II", warc_zstd.SKIPPABLE, len(dictionary)) + dictionary + b"".join(
        map(pack.compress, records))


def test_bad_archives_are_refused():
    body = b"<html>" + b"y" * 90_000
    good = warc_zstd.record("7", "u", body, hashlib.sha1(body).hexdigest(), None)
    read = list(warc_zstd.frames(archive(good, good), "a"))
    assert [t for _, t in read] == [good, good]
    assert warc_zstd.parsed(good, "a")["payload"] == body
    packed = zstandard.ZstdCompressor().compress(b"some dictionary text")
    assert [t for _, t in warc_zstd.frames(archive(good, dictionary=packed), "a")] == [good]
    for data in (b"", good, archive(good)[:-5], archive(good)[:40]):
        with pytest.raises(ValueError):
            list(warc_zstd.frames(data, "a"))
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"yyy", b"yyz", 1),
                good.replace(b"WARC-Date", b"X-Date"), good.replace(b"response\r\nW", b"other\r\nW", 1)):
        with pytest.raises(ValueError):
            warc_zstd.parsed(bad, "a")


def test_the_pipeline(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    final = QUERIES["pipeline"](spark, FOLDER).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in docs.collect()}
    kept = documents.where("lang is not null").count()
    assert len(final) > 0.7 * kept


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    from tools.compare import difference

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    assert difference(QUERIES[name](spark, FOLDER).toPandas(),
                      con.execute(ORACLES[name]).df()) == ""
