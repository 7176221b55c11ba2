import random
import re

import pytest

from tablewright.llm import jaccard_join


def brute(texts, k, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def cases():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 4)))
    base = [[word() for _ in range(rnd.choice((3, 20, 60, 120)))] for _ in range(12)]
    texts = [None, "", " \t\n", "One", "one", "a b c", "A b\nC", "a b", "é à", "É à"]
    for _ in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 6))):
            w[rnd.randrange(len(w))] = word()
        texts.append(rnd.choice((" ", "\n", "  ")).join(w))
    shared = " ".join(word() for _ in range(40))
    texts += [" ".join([word() for _ in range(30)] + [shared] + [word() for _ in range(20)]) for _ in range(40)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("tile", "large", "k", "percent"), [(4096, 64, 4, 85), (4, 2, 5, 80), (8, 1, 4, 85)])
def test_matches_brute_force(spark, monkeypatch, tile, large, k, percent):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs, k, percent).collect()}
    assert got == brute(texts, k, percent)


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "w")], "doc_id long, text string, n int" .replace("n int", "n string"))
    got = sorted([(r.doc_id, r.component_id) for r in jaccard_join.join_similar(docs).collect()], key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (3, 3)], key=str)
    kept = jaccard_join.one_of_each(docs).collect()
    assert sorted([(r.doc_id or 0) for r in kept]) == [0, 3, 5]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join_similar(none).collect() == []


def test_group_just_under_the_threshold(spark):
    """Many sets that pass the bitmap bound and don't link, a few that do, and one that a third of all rows are copies of."""
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(260):
        w = list(base)
        for at in rnd.sample(range(150), 3):
            w[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 130
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs, 4, 85).collect()}
    assert got == brute(texts, 4, 85)


def test_one_of_each_judges_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (2, a + " more", "y"), (2, b, "z"), (3, c, "u"), (3, c, "u"), (3, c + " more", "v"), (None, b + " more", "w"), (None, None, "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    assert sorted((r.doc_id or 0, r.text or "", r.th) for r in jaccard_join.one_of_each(docs).collect()) == sorted([(0, "", "n"), (0, "", "n"), (0, b + " more", "w"), (1, a, "x"), (2, b, "z"), (3, min([c, c + " more"], key=lambda t: kept(spark, t)), "v" if kept(spark, c + " more") < kept(spark, c) else "u")])


def kept(spark, text):
    from pyspark.sql import functions as F

    return spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def test_long_texts(spark):
    """Texts whose sets are larger than the largest bitmap."""
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10**5)}" for _ in range(120_000)]
    near, far = list(words), list(words)
    for at in rnd.sample(range(len(words)), 3000):
        near[at] = "n"
    for at in rnd.sample(range(len(words)), 8000):
        far[at] = "f"
    texts = [" ".join(w) for w in (words, near, far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs, 4, 85).collect()}
    assert got == brute(texts, 4, 85)


@pytest.mark.parametrize("few", [0, 250_000])
def test_components_of_few_links_without_shuffles(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few, raising=False)
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)]
    links = [(min(x), max(x)) for x in links if x[0] != x[1]]
    label = {n: n for x in links for n in x}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jaccard_join.components(spark.createDataFrame(links, "a long, b long").repartition(3))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.node: r.comp for r in got.collect()} == label
    assert got.rdd.getNumPartitions() == (1 if few else 4)
