"""Removal of byte strings that repeat anywhere in a corpus, by minimum-hash anchors; README says why not by prefix doubling.

Every string of the threshold length holds a gram that has the smallest hash in it, and copies of the string hold it at the same
place; only these positions, the anchors, are looked at. They are grouped by fingerprints of growing strings to the right, around
and to the left of the gram, and those that are alone are dropped; what is left is named by all that a string with this gram can
hold. Positions of one such name repeat in full. The others of a gram are compared at every start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, ship, sized, tidy

GRAM = 32
#: Positions of one gram that are compared in one task; those of more frequent grams are counted by a shuffle of their strings.
GROUP = 16384
PART = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, np.uint64)
POSITION = np.uint64((1 << 24) - 1)
ANCHORS = "pos array<int>, f array<long>, whole array<long>, r1 array<int>, l1 array<int>, r2 array<int>, m2 array<int>, l2 array<int>"


def _doubled(b: np.ndarray, upto: int, keep: frozenset[int] | None = None) -> dict[int, np.ndarray]:
    """Fingerprints of all strings of 1, 2, 4 ... upto bytes, by where they start; of the lengths in keep, if given."""
    h, n, out = TABLE[b], 1, {}
    while True:
        if keep is None or n in keep:
            out[n] = h
        if n >= upto:
            return out
        h = h[:-n] * (MULT + np.uint64(2 * n)) + h[n:]
        h ^= h >> np.uint64(29)
        n *= 2


def _powers(*lengths: int) -> frozenset[int]:
    return frozenset(1 << k for n in lengths for k in range(n.bit_length()) if n >> k & 1)


def _of_length(d: dict[int, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the strings of this length at these starts, from those of powers of two."""
    n = 1 << (length.bit_length() - 1)
    h = d[n][at]
    done = n
    while done < length:
        n = 1 << ((length - done).bit_length() - 1)
        h = h * (MULT + np.uint64(length)) + d[n][at + done]
        h ^= h >> np.uint64(31)
        done += n
    return h


def _anchors(raw: bytes, length: int) -> np.ndarray:
    """Where the gram with the smallest hash, the leftmost of equal ones, lies in some string of the threshold length."""
    found = []
    for begin in range(0, max(1, len(raw) - length + 1), PART):
        b = np.frombuffer(raw[begin : begin + PART + length - 1], np.uint8)
        if len(b) < length:
            continue
        h = _doubled(b, GRAM, frozenset((GRAM,)))[GRAM]
        m = (h * MULT & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        w = length - GRAM + 1
        n = 1
        while 2 * n <= w:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if n < w:
            m = np.minimum(m[: n - w], m[w - n :])
        at = (m & POSITION).astype(np.int64)
        found.append(begin + at[np.concatenate(([True], at[1:] != at[:-1]))])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _ranks(raw: bytes, at: np.ndarray, length: int) -> list[np.ndarray]:
    """f, whole and the ranks r1, l1, r2, m2, l2, which are 0 where the string doesn't lie in the text; part by part."""
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for begin in range(0, len(raw), PART):
        here = at[(at >= begin) & (at < begin + PART)]
        if len(here):
            low = max(0, begin - length)
            for o, x in zip(out, _part_ranks(raw[low : begin + PART + length], here - low, length), strict=True):
                o.append(x)
    return [np.concatenate(o) for o in out]


def _part_ranks(raw: bytes, at: np.ndarray, length: int) -> list[np.ndarray]:
    n, q, h, size = len(raw), length // 3, length * 5 // 8, 1 << (length.bit_length() - 1)
    d = _doubled(np.frombuffer(raw, np.uint8), size, _powers(GRAM, q, h, size))
    f = d[GRAM][at]

    def rank(shift: int, size: int) -> np.ndarray:
        start = at - shift
        ok = (start >= 0) & (start + size <= n)
        r = np.zeros(len(at), np.int64)
        r[ok] = (_of_length(d, start[ok], size) >> np.uint64(33)).astype(np.int64) | 1
        return r.astype(np.int32)

    lo, hi = np.maximum(0, at - (length - GRAM)), np.minimum(n, at + length)
    whole = d[size][lo] * MULT + (hi - lo).astype(np.uint64) * np.uint64(1 << 20) + (at - lo).astype(np.uint64)
    for start in (np.minimum(lo + size, hi - size), hi - size):
        whole = (whole ^ whole >> np.uint64(30)) * (MULT + np.uint64(6)) + d[size][start]
    # A string of the threshold length holds one of each: of q bytes either side of the gram's begin or end, of h bytes one of three.
    return [f, whole ^ whole >> np.uint64(32), rank(0, q), rank(q - GRAM, q), rank(0, h), rank(h // 2, h), rank(h - GRAM, h)]


def _signed(docs: DataFrame, length: int) -> DataFrame:
    """uid, doc_id, sha (of the text), n_bytes and the ranked positions of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 5]
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                raws = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                ats = [_anchors(raw, length) for raw in raws]
                columns: list[list[np.ndarray]] = [[] for _ in kinds]
                for raw, at in zip(raws, ats, strict=True):
                    made = [at.astype(np.int32), *(_ranks(raw, at, length) if len(at) else [at] * 7)]
                    for c, x, kind in zip(columns, made, kinds, strict=True):
                        c.append(x.view(np.int64) if kind == pa.int64() else x.astype(np.int32, copy=False))
                ends = pa.array(np.concatenate(([0], np.cumsum([len(a) for a in ats]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c), kind)) for c, kind in zip(columns, kinds, strict=True)]
                out = [pa.array(range(uid, uid + len(raws)), pa.int64()), part.column(0), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.array([len(r) for r in raws], pa.int64())]
                uid += len(raws)
                yield pa.RecordBatch.from_arrays([*out, *lists], ["uid", "doc_id", "sha", "n_bytes", "pos", "f", "whole", "r1", "l1", "r2", "m2", "l2"])

    return docs.mapInArrow(lambda rows: tidy(run(rows)), f"uid long, doc_id long, sha string, n_bytes long, {ANCHORS}")


def _round(positions: DataFrame, ranks: tuple[str, ...]) -> DataFrame:
    """The positions that have, with their gram, one of these ranks in common with another position."""
    pairs = positions.select("uid", "pos", "f", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(r).alias("r")) for i, r in enumerate(ranks)])).alias("x")).select("uid", "pos", "f", "x.d", "x.r").where("r <> 0")
    again = cut(pairs.groupBy("f", "d", "r").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    hit = pairs.join(sized(again), ["f", "d", "r"], "left_semi").select("uid", "pos").distinct()
    return cut(positions.join(hit, ["uid", "pos"], "left_semi"))


def _starts(rows: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of the threshold length that holds its row's gram: the row, the distance from start to gram, a hash.
    rows: f, uid, pos, n, off, ctx."""
    out: list[list[np.ndarray]] = [[], [], []]
    for first in range(0, len(rows), 1024):
        part = rows[first : first + 1024]
        seeds = np.array([r[0] for r in part], np.int64).view(np.uint64) * MULT
        flat = np.frombuffer(b"".join([r[5] for r in part]), np.uint8)
        sizes, offs = np.array([len(r[5]) for r in part], np.int64), np.array([r[4] for r in part], np.int64)
        begin = np.cumsum(sizes) - sizes
        n = np.minimum(offs, sizes - length) + 1
        row = np.repeat(np.arange(len(part)), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        h = _of_length(_doubled(flat, 1 << (length.bit_length() - 1), _powers(length)), begin[row] + start, length)
        i = offs[row] - start
        h = (h ^ h >> np.uint64(27)) * MULT + i.astype(np.uint64) * (MULT + np.uint64(10))
        h = (h ^ h >> np.uint64(31)) * (MULT + np.uint64(2)) + seeds[row]
        for o, x in zip(out, ((row + first).astype(np.int32), i.astype(np.int32), h ^ h >> np.uint64(29)), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def _runs(row: np.ndarray, i: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts as (row, first byte, byte after the last), relative to the gram."""
    order = np.lexsort((-i, row))
    row, s = row[order], -i[order]
    if not len(row):
        return row, s, s
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (s[1:] > s[:-1] + 1)))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(row)])) - 1
    return row[at], s[at], s[last] + length


def _compared(few: DataFrame, many: DataFrame | None, length: int) -> DataFrame:
    """uid, s, e: the bytes of the once-only contexts that a string found in another context of the same gram covers."""
    fields = ["f", "uid", "pos", "n", "off", "ctx"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(held) >= 4096 and held[-1][0] != r[0]:
                    yield held
                    held = []
                held.append(r)
        if held:
            yield held

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            row, i, h = _starts(rows, length)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            twice &= np.array([r[3] == 1 for r in rows])[row]  # those that stand for several are known to repeat
            row, s, e = _runs(row[twice], i[twice], length)
            uid, pos = np.array([r[1] for r in rows], np.int64)[row], np.array([r[2] for r in rows], np.int64)[row]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(pos + s), pa.array(pos + e)], ["uid", "s", "e"])

    out = few.select(*fields).repartition(F.col("f")).sortWithinPartitions("f").mapInArrow(lambda rows: tidy(within(rows)), "uid long, s long, e long")

    if many is None:
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (x[k : k + 1024] for x in groups(batches) for k in range(0, len(x), 1024)):
            row, i, h = _starts(rows, length)
            uid, pos = np.array([r[1] for r in rows], np.int64)[row], np.array([r[2] for r in rows], np.int64)[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(uid), pa.array(pos - i), pa.array(np.array([r[3] == 1 for r in rows])[row])], ["h", "uid", "s", "once"])

    strings = many.select(*fields).mapInArrow(each, "h long, uid long, s long, once boolean")
    twice = strings.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("once and n > 1")
    return out.unionByName(twice.select("uid", "s", (F.col("s") + length).alias("e")))


def repeated_spans(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): uid, doc_id, sha, n_bytes of every row, and doc_id, sha, spans (s, e; unmerged) where something repeats."""
    ship(docs.sparkSession)
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    signed = cut(_signed(docs, length))
    meta = signed.select("uid", "doc_id", "sha", "n_bytes")
    texts = cut(meta.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("uid").alias("first")))
    copied = cut(meta.join(texts.where("copies > 1"), "sha"))
    later = copied.where("uid <> first").select("uid")
    zipped = signed.join(sized(later), "uid", "left_anti").select("uid", "n_bytes", F.inline(F.arrays_zip("pos", "f", "whole", "r1", "l1", "r2", "m2", "l2")))

    again = cut(zipped.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f"))
    left = cut(zipped.join(sized(again), "f", "left_semi"))
    left = _round(_round(left, ("r1", "l1")), ("r2", "m2", "l2"))

    classes = cut(left.groupBy("f", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "pos")).alias("one")))
    repeat = left.join(sized(classes.where("n > 1").select("f", "whole")), ["f", "whole"], "left_semi")
    known = repeat.select("uid", F.greatest(F.lit(0), F.col("pos") - (length - GRAM)).cast("long").alias("s"), F.least("n_bytes", F.col("pos") + length).alias("e"))

    mixed = classes.groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("f", "c")
    wanted = cut(classes.join(mixed, "f").select("f", "n", "c", "one.uid", "one.pos").join(meta.select("uid", "doc_id", "sha"), "uid"))

    def contexts_of(places: DataFrame) -> DataFrame:
        asked = cut(places.groupBy("doc_id", "sha").agg(F.collect_list(F.struct("f", "n", "c", "uid", "pos")).alias("asked")))
        texts_of = docs.select(F.col("doc_id").alias("id"), "text").join(sized(asked, weight=F.size("asked") * 40 + 96), F.col("id").eqNullSafe(F.col("doc_id"))).select("sha", "asked", "text")
        return texts_of.mapInArrow(contexts, "f long, n long, c long, uid long, pos long, off long, ctx binary")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            out: list[tuple] = []
            for sha, places, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if hashlib.sha256(raw or b"").hexdigest() != sha:
                    continue
                for p in places:
                    lo = max(0, p["pos"] - (length - GRAM))
                    out.append((p["f"], p["n"], p["c"], p["uid"], p["pos"], p["pos"] - lo, raw[lo : p["pos"] + length]))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["f", "n", "c", "uid", "pos", "off", "ctx"])

    large = wanted.where(F.col("c") > GROUP)
    many = None if large.isEmpty() else contexts_of(large)
    spans = known.unionByName(_compared(contexts_of(wanted.where(F.col("c") <= GROUP)), many, length)).groupBy("uid").agg(F.array_distinct(F.collect_list(F.struct("s", "e"))).alias("spans"))
    alone = spans.join(meta, "uid").join(copied.select("uid"), "uid", "left_anti").select("doc_id", "sha", "spans")
    full = copied.where(F.col("n_bytes") >= length).select("doc_id", "sha", F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e"))).alias("spans"))
    return meta, cut(alone.unionByName(full).dropDuplicates(["doc_id", "sha"]))


def without(raw: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are removed, and the number of maximal removed runs."""
    kept, removed, runs, at = [], 0, 0, -1
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if at < 0 or s > at:
            kept.append(raw[max(at, 0) : s])
            runs += 1
            removed += e - s
            at = e
        elif e > at:
            removed += e - at
            at = e
    kept.append(raw[max(at, 0) :])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256")) -> DataFrame:
    """docs without its text column and with n_bytes, n_removed, n_spans, kept_sha256 or the kept text, as asked for.

    A byte of a text in UTF-8 is removed if a string of `length` bytes covers it that also starts anywhere else, in the same row or
    another; all copies go, overlaps count, and strings are judged on the input. Rows are apart from one another. A null text is an
    empty one; texts under `length` bytes stay as they are; a text that stands in two rows goes in full. Kept text drops what is
    left of characters that were cut. Texts count whole, of any length. Strings are compared by 64-bit hashes under equal grams.
    Columns of docs named like outputs are replaced, all others stay. An empty table gives an empty result.
    """
    kinds = {"n_bytes": (pa.int64(), "long"), "n_removed": (pa.int64(), "long"), "n_spans": (pa.int64(), "long"), "kept_sha256": (pa.string(), "string"), "text": (pa.string(), "string")}
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    _, spans = repeated_spans(thin, length)
    carry = [c for c in docs.columns if c != text and c not in outputs]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__carry"), F.col(doc_id).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__sha", F.sha2(F.col("__text").cast("binary"), 256))
    small = sized(spans.select(F.col("doc_id").alias("d"), "sha", "spans"), weight=F.size("spans") * 16 + 96)
    rows = rows.join(small, (F.col("__sha") == F.col("sha")) & F.col("__id").eqNullSafe(F.col("d")), "left").select("__carry", "__sha", "spans", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            made: dict[str, list] = {k: [] for k in outputs}
            for sha, cuts, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                kept, removed, runs = without(raw, cuts) if cuts else (raw, 0, 0)
                of = {"n_bytes": len(raw), "n_removed": removed, "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest() if cuts else sha, "text": kept.decode("utf-8", "ignore") if "text" in outputs else None}
                for k in outputs:
                    made[k].append(of[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(made[k], kinds[k][0]) for k in outputs]], ["__carry", *outputs])

    kind = rows.schema["__carry"].dataType.simpleString()
    out = rows.mapInArrow(lambda batches: tidy(run(batches)), f"__carry {kind}, " + ", ".join(f"{k} {kinds[k][1]}" for k in outputs))
    return out.select("__carry.*", *outputs)
