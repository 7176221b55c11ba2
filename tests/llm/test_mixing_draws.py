"""The mix's draws, and what follows from them, recomputed in Python."""

import random
from collections import Counter, defaultdict

from tablewright.llm import mixing


def test_taken_follows_from_the_drawn_slots(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.choice((0, 3, 200, 900))), rnd.choice("abcdef")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, pieces, slots = (x.collect() for x in mixing.mix(docs, block=16, slots_per_shard=512))
    shards = Counter(r.shard for r in slots)
    assert sorted(shards) == list(range(len(shards))) and set(list(shards.values())) <= {512, shards[len(shards) - 1]} and shards[0] == 512
    drawn = defaultdict(Counter)
    for r in slots:
        drawn[r.skey][r.shard] += 1
    assert all(len(set(c.values())) > 1 for c in drawn.values())  # counts of a source vary from shard to shard
    for key, c in drawn.items():  # but not more than draws do
        mean = sum(c.values()) / len(shards)
        assert all(abs(n - mean) < 6 * mean**0.5 + 6 for s, n in c.items() if shards[s] == 512)
    uses, places = Counter((r.skey, r.block) for r in slots), defaultdict(set)
    for r in slots:
        places[r.skey].add(r.slot)
    assert max(uses.values()) <= 2 and all(p == set(range(len(p))) for p in places.values())
    taken = Counter()
    for r in pieces:
        taken[r.doc_id] += r.n_words * uses[r.skey, r.block]
    assert {r.doc_id: r.taken for r in documents} == {i: taken[i] for i, _, _ in rows}


def test_ranges_change_nothing(spark, monkeypatch):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.randrange(60)), f"s{rnd.randrange(300)}" if i % 50 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(map(str, mixing.mix(docs)[0].collect()))
    monkeypatch.setattr(mixing, "FEW", 40)
    assert sorted(map(str, mixing.mix(docs)[0].collect())) == whole
