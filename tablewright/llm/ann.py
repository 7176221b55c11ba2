"""Nearest neighbours by inner product: a graph made by NN-descent, searched greedily.

Equal vectors are one node. Nodes that fall into the same cells of random hyperplanes start as each other's neighbours. In every
round each node brings its neighbours, and those it is a neighbour of, together: Spark joins them with their vectors, and pairs
that beat what either has so far become neighbours. A query walks the finished graph: the best nodes found so far that were not
opened yet are opened, their neighbours scored, and the best of all kept, until nothing among the best is left to open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, cut_in_loop, ship

#: Neighbours of a node, of those it is a neighbour of, tables of cells, nodes in a cell, and nodes scored in one task.
DEGREE, REVERSE, TABLES, CELL, BLOCK = 24, 16, 8, 384, 4096
#: Rounds go on until one changes less than this share of all neighbours, and end after so many.
SETTLED, ROUNDS = 0.05, 16
LIST = "array<long>"


def usable(vec: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array, scale: float | None = None) -> np.ndarray:
    """The vectors in double precision; or, with scale, divided by it and in single precision, for the graph."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (flat if scale is None else (flat / scale).astype(np.float32)).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one group each, from rows sorted by column 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        if held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b == len(key):
                held.append(batch.slice(a))
            else:
                yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists end to end, and the row of each."""
    sizes = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _as_lists(rows: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """n lists of values whose rows ascend."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each row's distinct ids stand, row by row, best first, equal scores by id; of equal ids one not late."""
    order = np.lexsort((late, ids, rows))
    r, i = rows[order], ids[order]
    order = order[np.concatenate(([True], (r[1:] != r[:-1]) | (i[1:] != i[:-1])))] if len(order) else order
    order = order[np.lexsort((ids[order], -scores[order], rows[order]))]
    r = rows[order]
    at = np.arange(len(r)) - np.searchsorted(r, r)
    return order[at < k]


def _cells(nodes: DataFrame, n: int, dim: int, scale: float) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / CELL)))))
    planes = np.random.default_rng(1).normal(size=(TABLES, dim, max(bits, 1))).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), scale)
            for t in range(TABLES if bits else 1):
                code = ((v @ planes[t] > 0) @ (1 << np.arange(max(bits, 1)))).astype(np.int64) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code * TABLES + t), batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["cell", "id", "v"])

    cells = nodes.select("id", "vec").mapInArrow(run, "cell long, id long, v binary")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(counts, "cell")
    return cells.select(F.xxhash64("cell", F.pmod(F.xxhash64(F.lit(2), "id"), F.ceil(F.col("n") / (3 * CELL)))).alias("cell"), "id", "v")


def _start(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids = t.column(1).to_numpy()
            v = np.frombuffer(b"".join(t.column(2).to_pylist()), np.float32).reshape(len(ids), -1)
            k = min(DEGREE, len(ids) - 1)
            if k < 1:
                continue
            s = v @ v.T
            np.fill_diagonal(s, -np.inf)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel())], ["id", "y", "s"])

    return cells.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(run, "id long, y long, s float")


def _merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    """The graph with the found (id, y, s): id, v, near, scores, fresh (not yet brought together)."""
    lists = found.groupBy("id").agg(F.collect_list("y").alias("ys"), F.collect_list("s").alias("ss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (old, old_rows), (had, _), (ys, y_rows), (ss, _) = (_lists(batch.column(c)) for c in range(2, 6))
            rows, ids, s = np.concatenate((old_rows, y_rows)), np.concatenate((old, ys)).astype(np.int64), np.concatenate((had, ss)).astype(np.float32)
            new = np.arange(len(rows)) >= len(old)
            at = _best(rows, ids, s, new, DEGREE)
            lists = [_as_lists(rows[at], batch.num_rows, x[at], kind) for x, kind in ((ids, pa.int64()), (s, pa.float32()), (new, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "v", "near", "scores", "fresh"])

    joined = graph.join(lists, "id", "left").select("id", "v", "near", "scores", "ys", "ss")
    return cut_in_loop(joined.mapInArrow(run, f"id long, v binary, near {LIST}, scores array<float>, fresh array<boolean>"))


def _brought_together(graph: DataFrame) -> DataFrame:
    """Pairs (id, y, s) that beat the worst neighbour of id, found among what meets at some node."""
    edges = graph.select("id", F.inline(F.arrays_zip("near", "fresh")))
    back = edges.select(F.col("near").alias("at"), F.col("id").alias("x"), "fresh")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("at", "x")))).where(F.col("r") <= REVERSE).drop("r")
    meet = edges.select(F.col("id").alias("at"), F.col("near").alias("x"), "fresh").unionByName(back)
    worst = F.when(F.size("scores") < DEGREE, F.lit(float("-inf")).cast("float")).otherwise(F.array_min("scores"))
    meet = meet.join(graph.select(F.col("id").alias("x"), "v", worst.alias("worst")), "x").select("at", "x", "fresh", "worst", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            x, fresh, worst = (t.column(c).to_numpy() for c in (1, 2, 3))
            v = np.frombuffer(b"".join(t.column(4).to_pylist()), np.float32).reshape(len(x), -1)
            s = v @ v.T
            ok = (s > worst[:, None]) & (x[:, None] != x[None, :]) & (fresh[:, None].astype(bool) | fresh[None, :].astype(bool))
            i, j = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[j]), pa.array(s[i, j])], ["id", "y", "s"])

    found = meet.repartition(F.col("at")).sortWithinPartitions("at").mapInArrow(run, "id long, y long, s float")
    return found.groupBy("id", "y").agg(F.max("s").alias("s"))


def build_graph(nodes: DataFrame, n: int, dim: int, scale: float = 1.0, rounds: int = ROUNDS) -> DataFrame:
    """id and near: each node's neighbours and the best of those it is a neighbour of, 2 * DEGREE at most."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "v"])

    graph = nodes.select("id", "vec").mapInArrow(whole, "id long, v binary").withColumns({"near": F.array().cast(LIST), "scores": F.array().cast("array<float>")})
    graph = _merged(graph, _start(_cells(nodes, n, dim, scale)))
    for _ in range(rounds):
        graph = _merged(graph, _brought_together(graph))
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed < SETTLED * DEGREE * n:
            break
    edges = graph.select("id", F.inline(F.arrays_zip("near", "scores")))
    back = edges.withColumn("r", F.row_number().over(Window.partitionBy("near").orderBy(F.desc("scores"), "id"))).where(F.col("r") <= DEGREE)
    both = edges.select("id", "near").unionByName(back.select(F.col("near").alias("id"), F.col("id").alias("near")))
    return cut(both.groupBy("id").agg(F.array_sort(F.collect_set("near")).alias("near")))


def _scored(work: DataFrame, nodes: DataFrame, blocks: int) -> DataFrame:
    """q, ids, scores for work (q, qvec, least, cands): candidates go to the blocks that hold their vectors; those over least return."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cands, rows = _lists(batch.column(3))
            block = np.mod(cands.astype(np.int64), blocks)
            order = np.lexsort((rows, block))
            cands, rows, block = cands[order], rows[order], block[order]
            first = np.concatenate(([True], (rows[1:] != rows[:-1]) | (block[1:] != block[:-1]))) if len(rows) else np.zeros(0, bool)
            part = np.cumsum(first) - 1
            of = pa.array(rows[first])
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), *[batch.column(c).take(of) for c in range(3)], _as_lists(part, int(first.sum()), cands, pa.int64())], ["block", "q", "qvec", "least", "cands"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], ["q", "ids", "scores"])
        ids = right.column("id").to_numpy()
        order = np.argsort(ids)
        v, ids = _matrix(right.column("vec").combine_chunks())[order], ids[order]
        qvec, least = _matrix(left.column("qvec").combine_chunks()), left.column("least").to_numpy()
        cands, rows = _lists(left.column("cands").combine_chunks())
        at = np.minimum(np.searchsorted(ids, cands), len(ids) - 1)
        fits = ids[at] == cands
        at, rows = at[fits], rows[fits]
        scores = np.empty(len(at))
        for a in range(0, len(at), 16384):
            scores[a : a + 16384] = (v[at[a : a + 16384]] * qvec[rows[a : a + 16384]]).sum(1)
        good = scores > least[rows]
        return pa.table([left.column("q").combine_chunks(), _as_lists(rows[good], n, ids[at[good]], pa.int64()), _as_lists(rows[good], n, scores[good], pa.float64())], ["q", "ids", "scores"])

    parts = work.select("q", "qvec", "least", "cands").mapInArrow(split, f"block long, q long, qvec {work.schema['qvec'].dataType.simpleString()}, least double, cands {LIST}")
    both = parts.groupBy("block").cogroup(nodes.select(F.pmod("id", F.lit(blocks)).alias("block"), "id", "vec").groupBy("block"))
    return both.applyInArrow(run, f"q long, ids {LIST}, scores array<double>")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, n: int, ef: int, starts: list[tuple[int, list[float]]]) -> DataFrame:
    """q, ids, scores: for queries (q, qvec), which are nodes, the ef best nodes found, best first, q's own among them.

    starts: a few nodes with their vectors, which travel with the tasks; every query scores them first.
    """
    blocks, kind = max(1, n // BLOCK), queries.schema["qvec"].dataType.simpleString()
    schema = f"q long, qvec {kind}, front {LIST}, ids {LIST}, scores array<double>, done array<boolean>"
    first_ids, first = np.array([s[0] for s in starts], np.int64), np.array([s[1] for s in starts], np.float64)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            q, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            rows, ids = np.repeat(np.arange(m), len(first_ids)), np.tile(first_ids, m)
            scores = np.concatenate([(first * x).sum(1) for x in v]) if len(first_ids) else np.zeros(0)
            other = ids != q[rows]
            rows, ids, scores = rows[other], ids[other], scores[other]
            at = _best(rows, ids, scores, np.zeros(len(rows), bool), ef)
            rows, ids, scores = rows[at], ids[at], scores[at]
            lists = [_as_lists(np.arange(m), m, q, pa.int64()), _as_lists(rows, m, ids, pa.int64()), _as_lists(rows, m, scores, pa.float64()), _as_lists(rows, m, np.zeros(len(rows), bool), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["q", "qvec", "front", "ids", "scores", "done"])

    state = cut(queries.select("q", "qvec").mapInArrow(begin, schema))
    step, width = 0, ef // 4

    def advance(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (old, old_rows), (had, _), (was, _), (new, new_rows), (got, _) = (_lists(batch.column(c)) for c in range(2, 7))
                rows, ids, scores = np.concatenate((old_rows, new_rows)), np.concatenate((old, new)).astype(np.int64), np.concatenate((had, got)).astype(np.float64)
                late = np.arange(len(rows)) >= len(old)
                done = np.concatenate((was.astype(bool), np.zeros(len(new), bool)))
                at = _best(rows, ids, scores, late, ef)
                rows, ids, scores, done = rows[at], ids[at], scores[at], done[at]
                front = ~done & (np.arange(len(rows)) - np.searchsorted(rows, rows) < k)
                m = batch.num_rows
                lists = [_as_lists(rows[front], m, ids[front], pa.int64()), _as_lists(rows, m, ids, pa.int64()), _as_lists(rows, m, scores, pa.float64()), _as_lists(rows, m, done | front, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["q", "qvec", "front", "ids", "scores", "done"])

        return run

    least = F.when(F.size("ids") < ef, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1))
    while True:
        fronts = state.select("q", F.explode("front").alias("id")).join(graph, "id").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("cands"))
        work = state.join(fronts, "q", "left" if step == 0 else "inner")
        cands = F.coalesce("cands", F.array().cast(LIST))
        work = work.select("q", "qvec", least.alias("least"), F.array_except(F.array_union(cands, F.array("q")) if step == 0 else cands, F.col("ids")).alias("cands"))
        got = _scored(work, nodes, blocks).groupBy("q").agg(F.flatten(F.collect_list("ids")).alias("new"), F.flatten(F.collect_list("scores")).alias("new_scores"))
        joined = state.join(got, "q", "left").select("q", "qvec", "ids", "scores", "done", "new", "new_scores")
        state = cut_in_loop(joined.mapInArrow(advance(width), schema))
        step, width = step + 1, min(ef, 2 * width)
        if step > 2 and state.where(F.size("front") > 0).isEmpty():
            return state.select("q", "ids", "scores")


def beam(n: int) -> int:
    """How many of the best nodes a search keeps: 320 up to 10,000 nodes, then 80 more for each doubling."""
    return int(320 + 80 * max(0.0, np.log2(max(1, n) / 10_000)))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, ef: int | None = None, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k nearest of all other rows that were found.

    Near is a large inner product in double precision of the vectors as they are; equal scores go by the smaller id. The graph is
    built on them in single precision, scaled to a largest component of one. Vectors that are null, zero, or hold a
    null or non-finite component take no part, nor do rows without an id; vectors of another length than the commonest take none
    either. Equal vectors are found together, all of them counted. Repeated rows of one id are one. Every vector is in the graph.
    With few rows a query gets all others. ef: nodes that a search keeps, beam(number of nodes) if not given. An empty table gives an empty result; other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    fine = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast(kind).alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    dim = fine.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.where(F.size("vec") == dim["d"])
    nodes = cut(fine.groupBy("vec").agg(F.min("vec_id").alias("id")))
    rows = cut(fine.join(nodes, "vec").select("id", "vec_id").distinct())
    n = nodes.count()
    scale = nodes.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    graph = build_graph(nodes, n, dim["d"], scale)
    starts = [(r["id"], r["vec"]) for r in nodes.orderBy(F.xxhash64(F.lit(4), "id")).select("id", "vec").limit(64).collect()]
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = cut(nodes.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("q"), F.col("vec").alias("qvec")))
    found = search(queries, nodes, graph, n, max(ef or beam(n), k + 1), starts)
    # The members of a node with the smallest ids; more than k + 1 of one node are never needed.
    members = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("id", "vec_id")
    top = found.select("q", F.inline(F.arrays_zip(F.slice("ids", 1, k + 1).alias("id"), F.slice("scores", 1, k + 1).alias("score"))))
    pairs = top.join(members, "id").select("q", "vec_id", "score")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    lists = pairs.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))).alias("list"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(lists, "q")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.m")).alias("score"))
