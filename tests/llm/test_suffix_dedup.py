import hashlib
import random

import pytest

from tablewright.llm import suffix_dedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for d, r in enumerate(raws):
        for i in range(len(r) - length + 1):
            seen.setdefault(r[i : i + length], []).append((d, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for r, g in zip(raws, gone, strict=True):
        runs = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((len(r), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(r, g, strict=True) if not x)).hexdigest()))
    return out


def cases():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, near = prose(140), prose(300)
    texts = [prose(60) + shared[rnd.randint(0, 200) : rnd.randint(380, 700)] + prose(50) for _ in range(30)]
    for _ in range(12):
        x = near.split(" ")
        x[rnd.randrange(len(x))] = "changed"
        texts.append(" ".join(x))
    texts += [None, "", "a" * 399, "a" * 900, "ab" * 700, prose(100), prose(20) + "ab" * 300, shared[:399], near, near, near[:500] + near[:500], "x" * 400, "y" * 401]
    return texts


def test_matches_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute(texts, 400)))


def test_frequent_grams_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    texts = cases()[:35]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 300).collect()}
    assert got == dict(enumerate(brute(texts, 300)))


@pytest.mark.parametrize("rows", [[], [(None, "z" * 500), (None, "z" * 500), (None, None)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted((len(t or ""), len(t or "")) for _, t in rows)
