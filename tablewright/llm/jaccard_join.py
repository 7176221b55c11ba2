"""Exact Jaccard self-join of documents on word shingles, and the components of its links.

Documents with equal shingle sets are one class. Two classes that are similar enough share one of the first shingles of each, in
an order common to all documents that puts very frequent shingles last. The classes that share such a shingle form a tile; only
those stay that have another one of fitting size beside them, and large tiles are cut into bands of set size and then by hash.
Within a tile, hashed bitmaps bound the overlap of two sets from above: bits of one that the other lacks are elements that it
lacks. Each class first meets its likeliest partner, exactly, by intersecting the sorted sets. Then the sets of those classes that
still have a passing partner in another component come into their tiles and are intersected there. No pair is ever a row unless
it is a link, or the one that a class asks first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import cut, cut_in_loop, salted, ship, sized, tidy

#: Classes, and bytes of their sets, in a tile before it is cut into bands and parts.
TILE, TILE_BYTES = 4096, 32 << 20
#: Documents in the sample that finds very frequent shingles: so many, or this share of all; and in how many documents one is frequent.
SAMPLE, SHARE, FREQUENT = 4000, 0.02, 400
#: Classes in a tile from which on its pairs are compared in the first tile that they share only.
LARGE = 64
#: Classes that meet one likeliest partner in one task, and places that one row of the list of places holds.
ASKERS, PLACES = 128, 1000
#: Parts of what overlapping tiles lead to, in the last round.
PARTS = 16
#: Links, both ways, up to which labels stand in one partition: about 4 MB.
FEW = 250_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of k words, A-Z lower-cased; of all words if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        s = (s + h[i : len(h) - n + 1 + i]) * MIX[i % len(MIX)]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(s: np.ndarray) -> bytes:
    """A bitmap of the set with at least four bits for each element, up to 8192; halves of a larger one joined give a smaller one."""
    bits = 64
    while bits < min(8192, 4 * len(s)):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[((s * MIX[4]) >> np.uint64(40)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """uid (of the row), doc_id, th (hash of the text), n, cls (a hash of the set, null for an empty one), first (the shingles that a partner must share one of), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            n, cls, first, bits = [], [], [], []
            for text in _texts(batch):
                s = shingle_set(text, k)
                n.append(len(s))
                if not len(s):
                    cls.append(None)
                    first.append(None)
                    bits.append(None)
                    continue
                cls.append(_class_of(s))
                late = np.isin(s, frequent, assume_unique=True) if len(frequent) else np.zeros(len(s), bool)
                first.append(np.concatenate((s[~late], s[late]))[: len(s) + percent * len(s) // -100 + 1].view(np.int64))
                bits.append(_bitmap(s))
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + len(n)), pa.int64()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["uid", "doc_id", "th", "n", "cls", "first", "bits"])
            uid += len(n)

    return docs.mapInArrow(lambda rows: tidy(run(rows)), "uid long, doc_id long, th long, n long, cls long, first array<long>, bits binary")


def frequent_shingles(docs: DataFrame, rows: int, k: int) -> np.ndarray:
    """Shingles of FREQUENT documents or more, estimated from a sample. They only change the order of shingles, no result."""
    share = min(1.0, max(SHARE, SAMPLE / max(rows, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {s.tobytes(): s for s in (shingle_set(t, k) for t in _texts(batch))}
            flat = np.concatenate([np.zeros(0, np.uint64), *sets.values()]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat)], ["s"])

    sampled = docs.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    least = max(8, int(FREQUENT * share))
    found = sampled.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= least).select("s").limit(1 << 20).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _beside(rows: DataFrame, percent: int) -> DataFrame:
    """Of (token, n, cls) the rows with another of their token beside them whose size fits, and some more at the borders of tasks.

    Sorted by token, size and class, a class without a fitting neighbour has no fitting partner at all. Ranges of all three split
    a token of any number of rows; the first and the last row of a range stay, whatever lies beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [np.zeros(0, np.int64)] * 3, True
        flag = np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            t, n, c = (np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held))
            keep = np.zeros(len(t), bool)
            keep[: len(flag)] = flag
            keep[0] |= first
            first = False
            near = (t[1:] == t[:-1]) & (percent * n[1:] <= 100 * n[:-1])
            keep[1:] |= near
            keep[:-1] |= near
            at = np.flatnonzero(keep[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (t, n, c)], ["token", "n", "cls"])
            held, flag = [x[-1:] for x in (t, n, c)], keep[-1:]  # the last row waits for the next batch
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["token", "n", "cls"])

    ranged = rows.repartitionByRange("token", "n", "cls").sortWithinPartitions("token", "n", "cls")
    return ranged.mapInArrow(run, "token long, n long, cls long")


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tiles from rows sorted by tile (column 0)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy(zero_copy_only=False)
        cut_at = int(np.searchsorted(tile, tile[-1])) if tile[0] != tile[-1] else 0
        if cut_at == 0 and held and held[-1].column(0)[-1].as_py() != tile[0]:
            yield pa.Table.from_batches(held)
            held = []
        elif cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


def _passing(tile: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs within the tiles (rows sorted by tile and n) that size and bitmaps allow, with the bound on their similarity."""
    flat = np.concatenate([np.frombuffer(b, np.uint64) for b in bits])
    width = np.array([0] + [len(b) // 8 for b in bits], np.int64)
    start, width = np.cumsum(width)[:-1], width[1:]
    end = np.searchsorted(tile, tile, "right")
    i, d = np.arange(len(tile)), 0
    while True:
        d += 1
        i = i[i + d < end[i]]
        i = i[percent * n[i + d] <= 100 * n[i]]
        if not len(i):
            return
        j = i + d
        ok, bound = np.zeros(len(i), bool), np.zeros(len(i))
        for w in np.unique(width[i]):
            at = np.flatnonzero(width[i] == w)
            for part in np.array_split(at, -(-len(at) // max(1, 200_000 // int(w)))):
                a = flat[start[i[part]][:, None] + np.arange(w)]
                b = np.zeros_like(a)
                for v in np.unique(width[j[part]]):
                    of = np.flatnonzero(width[j[part]] == v)
                    b[of] = np.bitwise_or.reduce(flat[start[j[part[of]]][:, None] + np.arange(v)].reshape(len(of), v // w, w), axis=1)
                lack_b = np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
                lack_a = np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
                most = np.minimum(n[i[part]] - lack_b, n[j[part]] - lack_a)  # elements that both can hold
                ok[part] = 100 * most >= percent * (n[i[part]] + n[j[part]] - most)
                bound[part] = most / (n[i[part]] + n[j[part]] - most)
        yield i[ok], j[ok], bound[ok]


def _earlier(tile: np.ndarray, mine: list[list[int] | None]) -> list[tuple[int, np.ndarray]]:
    """For each run of rows of one large tile: where it begins, and a bitmap per row of those smaller large tiles it shares."""
    out = []
    starts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a < 2 or mine[a] is None:
            continue
        lists = [np.array(x, np.int64) for x in mine[a:b]]
        lists = [x[x < tile[a]] for x in lists]
        ids, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        rank = np.cumsum(n > 1) - 1
        row = np.repeat(np.arange(b - a), [len(x) for x in lists])
        shared = n[at] > 1
        bits = np.zeros((b - a, int((n > 1).sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row[shared], rank[at[shared]] // 64), np.uint64(1) << (rank[at[shared]] % 64).astype(np.uint64))
        out.append((int(a), bits))
    return out


def _partners(tiles: DataFrame, percent: int) -> DataFrame:
    """tile, n, cls, large, partner, bound: the classes with a passing partner in their tile, and the likeliest. tiles: tile, n, cls, comp, bits, large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            tile, n, cls, comp = (t.column(k).to_numpy() for k in range(4))
            best, partner = np.zeros(len(cls)), np.full(len(cls), -1)
            for i, j, bound in _passing(tile, n, t.column(4).to_pylist(), percent):
                other = comp[i] != comp[j]
                for x, y in ((i[other], j[other]), (j[other], i[other])):
                    better = bound[other] > best[x]
                    best[x[better]], partner[x[better]] = bound[other][better], y[better]
            at = np.flatnonzero(partner >= 0)
            large = t.column(5).combine_chunks().take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(tile[at]), pa.array(n[at]), pa.array(cls[at]), large, pa.array(cls[partner[at]]), pa.array(best[at])], ["tile", "n", "cls", "large", "partner", "bound"])

    by_tile = tiles.select("tile", "n", "cls", "comp", "bits", "large").repartition(F.col("tile")).sortWithinPartitions("tile", "n")
    return by_tile.mapInArrow(lambda rows: tidy(run(rows)), "tile long, n long, cls long, large boolean, partner long, bound double")


def _apart(tiles: DataFrame, percent: int) -> DataFrame:
    """The rows (tile, n, cls, comp, large) that have a class of another component and of fitting size in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            tile, n, comp = (t.column(k).to_numpy() for k in (0, 1, 3))
            m = np.arange(len(tile))
            new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (comp[1:] != comp[:-1])))
            run_of = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            end = np.concatenate((begin[1:], [len(tile)]))
            left, right = begin[run_of] - 1, end[run_of]  # the nearest rows of another component, if of the same tile
            keep = np.zeros(len(tile), bool)
            ok = left >= 0
            keep[ok] |= (tile[left[ok]] == tile[m[ok]]) & (percent * n[m[ok]] <= 100 * n[left[ok]])
            ok = right < len(tile)
            keep[ok] |= (tile[right[ok]] == tile[m[ok]]) & (percent * n[right[ok]] <= 100 * n[m[ok]])
            yield pa.RecordBatch.from_arrays([t.column(k).combine_chunks().filter(pa.array(keep)) for k in range(5)], ["tile", "n", "cls", "comp", "large"])

    by_tile = tiles.select("tile", "n", "cls", "comp", "large").repartition(F.col("tile")).sortWithinPartitions("tile", "n")
    return by_tile.mapInArrow(run, "tile long, n long, cls long, comp long, large boolean")


def _exact(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, by their exact intersection."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(thin: DataFrame, classes: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """place, n, cls, comp, mark, mine, set for places (cls, place, comp, mark): a class's set, sent to each of its places; mine: its marked ones.

    The sets are made again from the texts of the documents that stand for the classes; the texts don't travel unless the list of
    places is too large to be sent out.
    """
    listed = salted(places, "cls", "place", PLACES)
    listed = listed.groupBy("cls", "salt").agg(F.collect_list(F.struct("place", "comp", "mark")).alias("places"))
    listed = cut(listed.join(classes.select("cls", F.col("min_id").alias("id")), "cls").select("id", "cls", "places"))
    small = sized(listed, weight=F.size("places") * 17 + 40)
    chosen = thin.join(small, thin["doc_id"].eqNullSafe(small["id"])).select("cls", "places", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
        names = ["place", "n", "cls", "comp", "mark", "mine", "set"]
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                for cls, mine, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _texts(part), strict=True):
                    s = shingle_set(text, k)
                    if not len(s) or _class_of(s) != cls:
                        continue
                    raw, marked = s.tobytes(), sorted(p["place"] for p in mine if p["mark"])
                    for p in mine:
                        rows.append((p["place"], len(s), cls, p["comp"], p["mark"], marked if p["mark"] else None, raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return chosen.mapInArrow(lambda rows: tidy(run(rows)), "place long, n long, cls long, comp long, mark boolean, mine array<long>, set binary")


def _together(left: DataFrame) -> DataFrame:
    """Fewer places for what is left (cls, n, place, comp, mark): tiles that overlap become one place, where a class stands once.

    What overlapping tiles lead to is cut into parts, and each two parts are a place, if there are PARTS at most; else tiles stay.
    """
    tiles = left.groupBy("place").agg(F.min("cls").alias("lead"))
    edges = left.join(tiles, "place").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct()
    label = components(edges).select(F.col("node").alias("cls"), F.col("comp").alias("label"))
    own = cut(left.select("cls", "n", "comp").distinct().join(label, "cls"))
    sizes = own.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") * 8 / TILE_BYTES)).alias("parts"))
    own = own.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("parts")))
    wide = own.where(F.col("parts") > PARTS).select("cls")
    own = own.where(F.col("parts") <= PARTS).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    place = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("place")
    return own.select("cls", place, "comp", (F.col("parts") > 1).alias("mark")).unionByName(left.join(wide, "cls", "left_semi").select("cls", "place", "comp", "mark"))


def _asked(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the one marked class of each place and those that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, hub_cls = None, None, None
        for batch in batches:
            a, b = [], []
            place, cls, mark, raw = (batch.column(k).to_pylist() for k in (0, 2, 4, 6))
            for p, c, m, r in zip(place, cls, mark, raw, strict=True):
                s = np.frombuffer(r, np.uint64)
                if m:
                    at, hub, hub_cls = p, s, c
                elif p == at and c != hub_cls and _exact(s, hub, percent):
                    a.append(min(c, hub_cls))
                    b.append(max(c, hub_cls))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    by_place = sets.repartition(F.col("place")).sortWithinPartitions(F.col("place"), F.col("mark").desc())
    return by_place.mapInArrow(lambda rows: tidy(run(rows)), "a long, b long").distinct()


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, found tile by tile (places): pairs that pass, likeliest first, unless joined already."""

    def links(t: pa.Table) -> tuple[list[int], list[int]]:
        tile, n, cls, comp = (t.column(k).to_numpy() for k in range(4))
        mine, raws = t.column(5).to_pylist(), t.column(6).to_pylist()
        sets = [np.frombuffer(r, np.uint64) for r in raws]
        earlier = _earlier(tile, mine)
        begins = np.array([a for a, _ in earlier], np.int64)
        ends = np.array([a + len(x) for a, x in earlier], np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, j, bound in _passing(tile, n, [_bitmap(s) for s in sets], percent):
            keep = comp[i] != comp[j]
            i, j, bound = i[keep], j[keep], bound[keep]
            if len(begins) and len(i):
                at = np.maximum(np.searchsorted(begins, i, "right") - 1, 0)
                large = (begins[at] <= i) & (i < ends[at])
                again = np.zeros(len(i), bool)
                for k in np.unique(at[large]):
                    of = np.flatnonzero(large & (at == k))
                    a, bits = earlier[k]
                    again[of] = (bits[i[of] - a] & bits[j[of] - a]).any(1)
                i, j, bound = i[~again], j[~again], bound[~again]
            found.append((i.astype(np.int32), j.astype(np.int32), bound.astype(np.float32)))
        i, j, bound = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int32) for k in range(3))
        order = np.argsort(-bound, kind="stable")
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        a, b = [], []
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            cx, cy = find(int(comp[x])), find(int(comp[y]))
            if cx != cy and _exact(sets[x], sets[y], percent):
                root[cx] = cy
                a.append(min(int(cls[x]), int(cls[y])))
                b.append(max(int(cls[x]), int(cls[y])))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            a, b = links(t)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    by_tile = sets.repartition(F.col("place")).sortWithinPartitions("place", "n")
    return by_tile.mapInArrow(lambda rows: tidy(run(rows)), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that links (a, b) lead to. Labels spread to neighbours and jump to their labels' labels.

    Up to FEW rows, what each round gives stands in one partition, which spares shuffles; beyond it the rounds are dealt out.
    """
    both = cut_in_loop(links.select("a", "b").union(links.select("b", "a")).distinct())
    few = both.limit(FEW + 1).count() <= FEW

    def made(rows: DataFrame) -> DataFrame:
        return cut_in_loop(rows).coalesce(1) if few else cut_in_loop(rows)

    both = made(both.coalesce(1)) if few else both
    labels = made(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        now = made(spread.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")))
        labels = now.select("node", "comp")
        if now.where(F.col("old") != F.col("comp")).isEmpty():
            return labels


def _tile(token: str, band: str, x: Column, y: Column) -> Column:
    return F.xxhash64(token, band, F.least(x, y), F.greatest(x, y)).alias("tile")


def _thin(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def join_similar(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    Two rows link when their sets of shingles of k words have a Jaccard similarity of percent / 100 or more. component_id is the
    smallest doc_id that links lead to, a row's own included. Links are looked for as long as they join something: no link between
    components is lost, and those within one aren't counted. A text of fewer words is one shingle. A null or empty text has no
    shingles, links with nothing, and has its own doc_id as component_id. Null doc_ids are larger than all others, and null only
    where a component has no other. Repeated rows are linked and all returned. Whole texts count, of any length; shingles are
    compared by 64-bit hashes. An empty table gives an empty result; other columns aren't read.
    """
    signed, of_class = _components_of(_thin(docs, doc_id, text), k, percent)
    empty = signed.where(F.col("cls").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return signed.where(F.col("cls").isNotNull()).join(of_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def _components_of(thin: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (cls, comp, component_id) for every class; comp tells components apart."""
    ship(thin.sparkSession)
    signed = cut(signatures(thin, k, percent, frequent_shingles(thin, thin.count(), k)))
    with_set = signed.where(F.col("cls").isNotNull())
    classes = cut(with_set.groupBy("cls").agg(F.min("doc_id").alias("min_id"), F.min("uid").alias("rep")))
    copies = cut(with_set.select("cls", "uid").join(classes, "cls").where(F.col("uid") != F.col("rep")).select("uid"))
    one = with_set.join(sized(copies, 2_000_000), "uid", "left_anti")

    found = cut(_beside(one.select(F.explode("first").alias("token"), "n", "cls"), percent))
    # Shingles that the same classes share need one tile only.
    tokens = found.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("mark")).where("size > 1")
    tokens = tokens.groupBy("size", "weight", "lo", "hi", "mark").agg(F.min("token").alias("token"))
    parts = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("weight") * 8 / TILE_BYTES)).cast("long")
    tokens = cut(tokens.select("token", (F.col("size") > LARGE).alias("large"), parts.alias("parts")))
    members = found.join(tokens, "token")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    near = F.when(F.col("parts") > 1, F.array(band - 1, band)).otherwise(F.array(F.lit(-9).cast("long")))
    members = cut(members.select("token", "cls", "n", "large", "parts", F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("parts")).alias("own"), F.explode(near).alias("band")))

    bits = one.select("cls", "bits")
    tiles = members.select(_tile("token", "band", F.col("own"), F.col("own")), "n", "cls", F.col("cls").alias("comp"), "large")
    passed = cut(_partners(tiles.join(bits, "cls"), percent))

    # Each class asks its likeliest partner; many may ask one, which then stands in many places.
    asks = passed.groupBy("cls").agg(F.max(F.struct("bound", "partner")).alias("best")).select("cls", F.col("best.partner").alias("hub"))
    pair = asks.groupBy(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    asks = cut(salted(pair.select(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("cls"), "hub"), "hub", "cls", ASKERS))
    nothing = F.lit(0).cast("long").alias("comp")
    places = asks.select("cls", F.xxhash64("hub", "salt").alias("place"), nothing, F.lit(False).alias("mark"))
    hubs = asks.select(F.col("hub").alias("cls"), F.xxhash64("hub", "salt").alias("place"), nothing, F.lit(True).alias("mark")).distinct()
    links = cut(_asked(_sets(thin, classes, places.unionByName(hubs), k), percent))
    comps = components(links)

    def with_comp(rows: DataFrame) -> DataFrame:
        return rows.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    # Pairs that pass and whose components differ still; those of large tiles' other parts haven't been looked at before.
    left = _apart(with_comp(passed.select("tile", "n", "cls", "large")), percent)
    if not members.where("parts > 1").isEmpty():
        wide = with_comp(members.where("parts > 1"))
        several = wide.groupBy("token", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "band")
        wide = wide.join(several, ["token", "band"], "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("own <> other")
        cross = _apart(wide.select(_tile("token", "band", F.col("own"), F.col("other")), "n", "cls", "comp", "large"), percent)
        more = _partners(cross.join(bits, "cls"), percent).select("tile", "n", "cls", "large")
        left = left.unionByName(with_comp(more).select(*left.columns))
    left = cut(left.select("cls", "n", F.col("tile").alias("place"), "comp", F.col("large").alias("mark")))
    if not left.isEmpty():
        later = cut(_joined(_sets(thin, classes, _together(left), k), percent))
        if not later.isEmpty():
            links = links.unionByName(later)
            comps = components(links)

    labelled = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "min_id", F.coalesce("comp", "cls").alias("comp"))
    smallest = labelled.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    return signed, cut(labelled.join(smallest, "comp").select("cls", "comp", "component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but of each component of join_similar one row only.

    That with the smallest doc_id stays (null is larger than all others), of several the one whose text has the smallest hash, of
    repeated rows one. Rows without a doc_id, and those without words, stay. Rows are judged one by one, also where they share a
    doc_id. Otherwise as there.
    """
    signed, of_class = _components_of(_thin(docs, doc_id, text), k, percent)
    rows = signed.where(F.col("cls").isNotNull()).join(of_class, "cls").select("comp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th").alias("row"))
    rows = cut(rows.groupBy("comp", "row").agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("comp").agg(F.min("row").alias("best"))
    rows = rows.join(best, "comp").select((F.col("row") == F.col("best")).alias("stays"), F.col("row.doc_id").alias("__id"), F.col("row.th").alias("__th"), "n").where("__id is not null")

    def named(chosen: DataFrame) -> DataFrame:
        return sized(cut(chosen.select("__id", "__th")), weight=F.lit(40))

    def same(other: DataFrame) -> Column:
        return F.col(doc_id).cast("long").eqNullSafe(other["__id"]) & (F.xxhash64(F.col(text)) == other["__th"])

    gone, again = named(rows.where("not stays")), named(rows.where("stays and n > 1"))
    out = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return out
    apart = out.join(again, same(again), "left_anti")
    return apart.unionByName(out.join(again, same(again), "left_semi").dropDuplicates([doc_id, text]))
