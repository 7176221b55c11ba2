import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import ann, bpe, langid, mixing, quality, sharding, url_filter
from tablewright.llm.queries import URL_RULES, vocabulary


# URL rules.
def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cutoff = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cutoff])
    path = rest[cutoff:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_rules(spark):
    urls = [None, "", "no", "http://", "http://com/", "http://COM", "https://a.com/x?y=/z", "http://www.example.com/en/1", "http://example.com/en/", "http://notexample.com/en/", "http://b.example.com/en", "http://x.net/es/1#t", "http://net/es/", "http://x.net/en/", "http://x.com?a/b", "a://b://c.com/d", "http://..com/x", "http://É.com/é"] * 2
    rules = [*URL_RULES, ("allow", "example.com", "/en/1"), ("block", "a.com", "/")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for chosen in (URL_RULES, rules, []):
        for parts in (1, 5):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.apply_url_rules(pages, chosen, partitions=parts).collect()}
            assert got == {i: judged(u, chosen) for i, u in enumerate(urls)}
    assert url_filter.apply_url_rules(pages.limit(0), URL_RULES).collect() == []


# Shards.
def test_shards(spark):
    rows = [(None if i % 97 == 0 else i // 2, i % 300 + 1, "x") for i in range(2000)] + [(5, 6, "same")] * 40
    records = spark.createDataFrame(rows, "doc_id long, size long, slot string")
    out = sharding.shuffled_shards(records, n_shards=5, bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((a, b) for a, b, _ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 5
    assert len({r.bucket for r in out}) > 3 and len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    again = sharding.shuffled_shards(records, n_shards=6, bucket_bytes=4000).collect()
    assert {r.doc_id: r.grown_shard for r in out} == {r.doc_id: r.shard for r in again}
    assert sharding.shuffled_shards(records.limit(0)).collect() == []


# Quality.
def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 0), (2, "", None, 0), (3, "w " * 9, "a", 0), (4, " ".join(f"w{i}" for i in range(30)), "a", 0), (4, " ".join(f"w{i}" for i in range(30)), "a", 0), (5, "\n".join(["one two three four five six"] * 4), "b", 0), (6, "é# \x0b*\n\nx\nx\r\n x", None, 0)], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge_documents(docs).collect()}
    assert got == {1: (0, 0, 0, 0, 0, True), 2: (0, 0, 0, 0, 0, True), 3: (9, 9, 0, 0, 9, True), 4: (30, 80, 0, 0, 0, False), 5: (24, 88, 0, 3, 24, True), 6: (5, 6, 2, 0, 0, True)}
    assert [r.doc_id for r in quality.keep_documents(docs, max_rate=0.9).collect()] == [4, 4]
    assert quality.judge_documents(docs.limit(0)).collect() == []
    many = spark.createDataFrame([(i, "short" if i % 10 else " ".join(f"w{i}" for i in range(30)), "bad") for i in range(100)] + [(1000 + i, " ".join(f"w{k}" for k in range(30)), "good") for i in range(100)], "doc_id long, text string, source string")
    assert {r.source for r in quality.keep_documents(many).collect()} == {"good"}


# Mixing.
def level(sizes, weights, total):
    open_, out, left = dict(weights), {}, total
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_mixing(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice((0, 1, 50, 700))), rnd.choice(["a", "b", "é", "c", "d", None])) for i in range(900)] + [(7, "x y z", "a"), (7, "x y z", "a"), (None, "q", "b"), (8, None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs)[0].collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    target = level(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * (1 + r.target) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(64, 0.02 * target[s]) for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(3))[0].collect()))
    copies = Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect())
    assert max(copies.values()) <= 4 and mixing.mix(docs.limit(0))[0].collect() == []


def test_mixed_documents_write_what_the_mix_drew(spark):
    """Long documents, of which the mix takes about a tenth, one and a half and two of each word."""
    rnd = random.Random(4)
    text = lambda n, i: " \n"[i % 2] + "".join(f"w{i}.{k}" + rnd.choice((" ", "\n", "\t ")) for k in range(n))
    rows = [(i, text(rnd.choice((40, 1500, 4000)), i), "abc"[i % 3]) for i in range(60)] + [(700, text(900, 100 + i), "b") for i in range(4)] + [(None, text(300, 200), None), (800, " ", "a"), (801, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1, 4, 20), (5, 2, 1)):
        drawn, target = Counter(), {}
        for r in mixing.mix(docs, weights=weights)[0].collect():
            drawn[r.source, r.doc_id] += r.taken
            target[r.source] = r.target
        written, words = Counter(), Counter()
        of = {w: (i, s) for i, t, s in rows for w in (t or "").split()}
        for r in mixing.mixed_documents(docs.repartition(3), weights=weights).collect():
            written[r.source, r.doc_id] += len(r.text.split())
            words.update(r.text.split())
            assert all(of[w] == (r.doc_id, r.source) for w in r.text.split())
        assert written == +drawn and max(words.values()) <= 2
        for s in target:
            assert abs(sum(n for (x, _), n in written.items() if x == s) - target[s]) <= max(128, 0.02 * target[s])
    whole = {r.text for r in mixing.mixed_documents(docs, weights=(1, 4, 20)).where("source = 'c'").collect()}
    assert len(whole & {t for _, t, s in rows if s == "c"}) == 20


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1000):
        got = sorted(r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("k"))).collect())
        assert got == list(range(n))


# BPE.
def test_bpe_against_library(spark):
    path, lib = vocabulary(), Tokenizer.from_file(vocabulary())
    texts = [None, "", " ", "a  b", "x\n y", "x\n\n y ", "it's <|endoftext|> ok<|endoftext|>", "a" * 3000, "ab" * 999, "日本 語　テ\x1c\x85x", "\t\ta\r\nb", "é  é", "12 345a ²³", "a \n\nb", "!!??..\n", "I'LL we'll don't", "\ufffd\u0301 o\u0301", "word, word. word! (word) 'word'"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(2)
    for r in bpe.encode_documents(docs, path, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(ids), ids, back)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), path).collect() == []
    with pytest.raises(ValueError):
        bpe.encode_documents(docs, path, carry=("doc_id", "n_tokens"))


# Language.
def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, carry=("doc_id", "lang")).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 !? ²", "de"), (None, "hello", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}[3] == "und"
    assert langid.identify(odd.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(odd.where("lang is null")).collect()} == {"und"}


# Neighbours.
def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (None, x[0].tolist()), (2080, [1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    assert sorted(by) == list(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert sorted(found) == list(range(1, 21)) and all(abs(s[v] - score) < 1e-12 for v, score in found.values())
        order = [found[k] for k in range(1, 21)]
        assert order == sorted(order, key=lambda p: (-p[1], p[0]))
        hits += len(set(best) & {v for v, _ in found.values()})
    assert hits / (20 * len(by)) >= 0.9
    few = ann.nearest(spark.createDataFrame(rows[:3] + [(20, [1.0] * 24)], "vec_id long, embedding array<float>")).collect()
    assert Counter(r.query_id for r in few) == {0: 3, 20: 3}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_neighbours_in_a_dense_group(spark):
    """A third of the rows are near copies of one vector, nearer to one another than half precision can tell."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + 0.01 * x[::3]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in ann.nearest(docs, every=90).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 9000, 90):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        hits += len(found[q] & set([i for i in np.lexsort((np.arange(9000), -s)) if i != q][:20]))
    assert hits / (20 * 100) >= 0.95, hits / (20 * 100)


def test_neighbours_of_doubles(spark):
    """Scores are those of the vectors as they are, also where single precision can't hold them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 1e60
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(docs).collect()
    assert len(got) == 15 * 20
    for r in got:
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) <= 1e-12 * abs(r.score)
    assert all(r.vec_id == max((i for i in range(300) if i != r.query_id), key=lambda i: x[r.query_id] @ x[i]) for r in got if r.rank == 1)


def test_every_language_is_learned(spark):
    """Over 200 languages, each with its own letters; a long text; names that clash."""
    letters = [chr(0x4E00 + i) for i in range(230)]
    rows = [(1000 * i + k, (c + " ") * 6, f"l{i:03}") for i, c in enumerate(letters) for k in range(8)] + [(10**7, "\u4e05 " * 700_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {lang for _, lang in langid.training_rows(docs)}
    assert len(learned) == 230
    small = langid.training_rows(docs, most=500)
    assert len(small) <= 2 * 2 * 230
    out = {r.doc_id: r for r in langid.identify(docs.where("doc_id < 20000 or doc_id = 10000000")).collect()}
    assert out[10**7].lang_pred == "l005" and len(out) == 20 * 8 + 1
    with pytest.raises(ValueError):
        langid.predict(docs.withColumnRenamed("lang", "score"), None, carry=("doc_id", "score"))
