"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, permuted block indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, key_of, word_count

ROUNDS = 8
#: Rows that one window without a key may hold.
FEW = 100_000
#: A word with the white space after it, the first one also with what is before it.
WORD = r"(?:\A[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def running(rows: DataFrame, n: int, order: list[Column], **sums: str) -> DataFrame:
    """rows with, for each name in sums, the sum of that column over the rows before, in this order.

    Up to FEW rows (n: their number) are one window. More are cut into ranges: sums of the ranges, then sums within a range; no task
    sees more than a range, or one row for each range.
    """
    before = Window.unboundedPreceding
    if n <= FEW:
        w = Window.orderBy(*order).rowsBetween(before, -1)
        return rows.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()})
    ranged = cut(rows.repartitionByRange(max(2, 2 * n // FEW), *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(*[F.sum(v).alias(f"__of_{k}") for k, v in sums.items()])
    w = Window.orderBy("__range").rowsBetween(before, -1)
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__of_{k}").over(w), F.lit(0)).alias(f"__to_{k}") for k in sums])
    w = Window.partitionBy("__range").orderBy(*order).rowsBetween(before, -1)
    out = ranged.join(totals, "__range").withColumns({k: F.col(f"__to_{k}") + F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()})
    return out.drop("__range", *[f"__to_{k}" for k in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size, n_docs and target.

    Sources in order of code points, null last, take the weights in turn and share `share` times all sizes by weight; no target is
    over `most` times its source's size, and what is over is shared again. Sorted by the level at which a source is full, the final
    level is the largest of the levels reached when all sources before one are full.
    """
    sources = cut(sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).withColumn("one", F.lit(1)))
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()
    sources = running(sources, total["n"], [F.col("source").asc_nulls_last()], rank="one")
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int") + 1))
    sources = cut(sources.withColumn("full", F.lit(most) * F.col("source_size")))
    of_all = sources.agg(F.sum("weight").alias("weight")).first()["weight"] or 0
    filled = running(sources, total["n"], [(F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], full_before="full", weight_before="weight")
    reached = (F.lit(share * total["size"]) - F.col("full_before")) / (F.lit(of_all) - F.col("weight_before"))
    level = filled.agg(F.max(reached)).first()[0] or 0.0
    return sources.select("skey", "source", "source_size", "n_docs", "weight", F.least(F.col("full"), F.lit(level) * F.col("weight")).alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1 for every key: rounds of swap-or-not, which need no power of two."""

    def one(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, one)


def mix(docs: DataFrame, block: int = 64, slots_per_shard: int = 4096, seed: int = 23, text: str = "text", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix.

    documents: doc_id, source, size (words), source_size, target, taken (words that the mix takes, repeats counted); one row per
    row of docs. pieces: which words of a document lie in which block of its source. slots: shard, source, block; joined with
    pieces by block they are the mix. The documents of a source are packed end to end into blocks of `block` words, the last one
    shorter. A source has places in proportion to its target, at most `most` for each block. Output shards hold slots_per_shard
    places, the last one fewer. How many of each source a shard gets is drawn: a seeded permutation of all places deals them to the
    shards, so the counts are multinomial given every source's total. These counts, taken shard by shard, give a source its slots:
    slot j is block j mod n of a permutation that has its own key for every pass. All draws follow from the seed, so reruns agree.
    Null and empty texts have size 0 and are never taken; a null source is a source of its own. Repeated rows are documents of their
    own. Other columns of docs aren't read. Empty tables give empty results.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), key_of(F.col("source")).alias("skey"), word_count(F.col(text)).alias("size")))
    targets = cut(source_targets(sized, weights, share, most))
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    plans = targets.withColumn("n_blocks", n_blocks).withColumn("n_slots", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * n_blocks), F.lit(most) * n_blocks)).otherwise(F.lit(0)).cast("long"))
    rows, all_slots = sized.count(), plans.agg(F.sum("n_slots")).first()[0] or 0

    # Where a document begins in its source: parts of a source by hash, sums of the parts, then sums within a part.
    n_parts = max(1, rows // 10_000)
    parted = sized.where("size > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)))
    sums = parted.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    begin = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "part", F.coalesce(F.sum("part_size").over(begin), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("skey", "part").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = parted.withColumn("upto", F.sum("size").over(within)).join(sums, ["skey", "part"])
    placed = placed.select("doc_id", "skey", "size", (F.col("part_start") + F.col("upto") - F.col("size")).alias("start"))

    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("doc_id", "skey", "size", "start", "block", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))

    # How many places of a source each shard gets. Places in runs, so that no row grows with its source.
    run, tasks = 8192, max(1, min(4096, -(-all_slots // (8 * 8192))))
    held = cut(plans.where("n_slots > 0").select("skey", "n_blocks", "n_slots"))
    held = cut(running(held, held.count(), [F.col("skey").asc()], place="n_slots"))
    runs = held.select("skey", "place", "n_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / run))).alias("run")).repartition(tasks, "skey", "run")
    dealt = runs.select("skey", F.explode(F.sequence(F.col("place") + F.col("run") * run, F.col("place") + F.least((F.col("run") + 1) * run, F.col("n_slots")) - 1)).alias("place"))
    at = permuted(F.col("place").cast("long"), F.lit(all_slots).cast("long"), F.lit(seed))
    counts = cut(dealt.select("skey", F.floor(at / slots_per_shard).cast("long").alias("shard")).groupBy("skey", "shard").agg(F.count(F.lit(1)).alias("drawn")))
    # Where a shard's slots begin among those of a source: sums of groups of shards, then sums within a group.
    counts = counts.withColumn("group", F.floor(F.col("shard") / run).cast("long"))
    groups = counts.groupBy("skey", "group").agg(F.sum("drawn").alias("of_group"))
    earlier = Window.partitionBy("skey").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("skey", "group", F.coalesce(F.sum("of_group").over(earlier), F.lit(0)).alias("group_start"))
    earlier = Window.partitionBy("skey", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("drawn").over(earlier), F.lit(0))).join(groups, ["skey", "group"])
    starts = starts.join(held.select("skey", "n_blocks"), "skey").select("skey", "shard", "n_blocks", "drawn", (F.col("group_start") + F.col("start")).alias("start")).repartition(tasks, "skey", "shard")
    slots = starts.select("skey", "shard", "n_blocks", F.explode(F.sequence("start", F.col("start") + F.col("drawn") - 1)).alias("slot"))
    slots = slots.select("shard", "skey", "slot", permuted(F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.lit(seed + 1), F.xxhash64("skey", F.floor(F.col("slot") / F.col("n_blocks")))).alias("block"))
    uses = slots.groupBy("skey", "block").agg(F.count(F.lit(1)).alias("uses"))
    taken = pieces.join(uses, ["skey", "block"]).groupBy("skey", "start", "doc_id").agg(F.sum(F.col("n_words") * F.col("uses")).alias("taken"))
    rows_of = placed.join(taken.withColumnRenamed("doc_id", "taken_id"), ["skey", "start"], "left").select("doc_id", "skey", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = sized.where("size = 0").select("doc_id", "skey", "size", F.lit(0).cast("long").alias("taken"))
    documents = rows_of.unionByName(none).join(targets.select("skey", "source", "source_size", "target"), "skey").select("doc_id", "source", "size", "source_size", "target", "taken")
    return documents, pieces, slots


def mixed_documents(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """What the mix takes of the rows of docs: all their columns, the text cut to the words taken.

    A row appears once with its words that the mix takes at all, once more with those that it takes twice, and so on: the words
    written are those of mix()'s slots, no more and no fewer. White space stays as it was; a text that is taken whole is unchanged.
    Rows that the mix takes nothing of, and rows without words, don't appear. Columns of docs whose names begin with two underscores
    are an error. Otherwise as mix().
    """
    if clash := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns with reserved names: {clash}")
    _, pieces, slots = mix(docs, text=text, **how)
    uses = slots.groupBy("skey", "block").agg(F.count(F.lit(1)).cast("int").alias("uses"))
    part = F.struct(F.col("first_word").cast("int").alias("first_word"), F.col("n_words").cast("int").alias("n_words"), F.coalesce("uses", F.lit(0)).alias("uses"))
    parts = pieces.join(uses, ["skey", "block"], "left").groupBy("skey", "start", "doc_id", "size").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    # Rows of one doc_id, source and size are numbered on both sides; no value of the keys is null.
    keys = ["__id", "__source", "__size"]
    parts = parts.select(key_of(F.col("doc_id")).alias("__id"), F.col("skey").alias("__source"), F.col("size").alias("__size"), "start", F.filter("parts", lambda x: x["uses"] > 0).alias("__parts"))
    parts = cut(parts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("start").where(F.size("__parts") > 0))
    rows = docs.withColumns({"__id": key_of(F.col("doc_id").cast("long")), "__source": key_of(F.col("source")), "__size": word_count(F.col(text))}).where("__size > 0")
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(text)))
    # In a condition of its own the number is no key, so that the join can use the window's partitions.
    rows = rows.join(parts, keys).where(F.coalesce(F.col("__at") == F.col("__r"), F.lit(False)))
    rows = rows.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("__parts", lambda x: x["uses"])))))
    chosen = F.filter("__parts", lambda x: x["uses"] >= F.col("__pass"))
    rows = rows.withColumn(text, F.array_join(F.flatten(F.transform(chosen, lambda x: F.slice("__words", x["first_word"] + 1, x["n_words"]))), ""))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
