"""Shards against a brute-force version, written and read back."""

import zlib
from collections import Counter, defaultdict

from tablewright.llm import sharding
from tablewright.llm.queries import op4_sharding
from tests.compare import DIR


def test_query_returns_every_document_once(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    out = op4_sharding(spark, DIR).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()} and len(out) == len(docs)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key" and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = len(docs) / 16
    assert all(abs(len(s) - mean) < 6 * mean**0.5 for s in slots.values())


def test_copies_and_a_hot_key(spark, tmp_path):
    rows = [(7, "same", 5)] * 3000 + [(7, f"text {i}", 7) for i in range(2000)] + [(i, "x" * (i % 40), i % 40 + 1) for i in range(1500)] + [(None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long").repartition(6)
    sharding.write_shards(docs, str(tmp_path / "s"), n_shards=4, bucket_bytes=4000)
    out = sharding.read_shards(spark, str(tmp_path / "s"), docs).collect()
    assert Counter((r.doc_id, r.text, r.size) for r in out) == Counter(rows)
    buckets, slots, order = Counter((r.shard, r.bucket) for r in out), defaultdict(list), defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        order[r.shard, r.bucket].append((r.slot, r.text or ""))
    assert max(buckets.values()) < 1400 and all(sorted(s) == list(range(len(s))) for s in slots.values())  # 3000 copies aren't in one bucket
    assert len({r.shard for r in out if r.doc_id == 7}) == 1
    assert any([t for _, t in sorted(o)] != sorted(t for _, t in o) for o in order.values())
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none"), docs).collect() == []
