"""Shards of shuffled records: scatter into memory-sized buckets by seeded hashes, then Fisher-Yates within each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, sized


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard with the largest hash of seed, key and shard number: one more shard takes keys only into itself."""
    scored = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i")))
    return F.array_max(scored)["i"]


def shuffled_shards(records: DataFrame, key: str = "doc_id", size: str = "size", n_shards: int = 16, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Adds shard, bucket, slot and grown_shard to records; all rows and other columns stay.

    The key and the number of shards decide the shard, so rows of one key stay together, and grown_shard is the shard with one
    shard more: either the same or the new one. Pass one sends each record to a bucket of its shard by a seeded hash of the whole
    record, as many buckets as hold bucket_bytes each on average; pass two shuffles every bucket with Fisher-Yates and numbers the
    rows without gaps from 0 in each shard. Copies of a record that would fill a quarter of a bucket are numbered, and the number
    goes into the hash. Null keys are one key, null sizes count nothing. Equal rows may be exchanged for one another, and the order
    within a bucket depends on Spark's partitions; nothing else varies between runs. An empty table gives an empty result. Columns
    named shard, bucket, slot or grown_shard are replaced.
    """
    records = records.drop("shard", "bucket", "slot", "grown_shard")
    columns = [F.col(f"`{c}`") for c in records.columns]
    sized_rows = records.select(F.struct(*columns).alias("record"), F.xxhash64(F.lit(seed + 1), *columns).alias("hash"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("bytes"), shard_of(F.col(key), n_shards, seed).alias("shard"))
    hot = cut(sized_rows.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > bucket_bytes // 4) & (F.col("n") > 1)).select("hash"))
    if not hot.isEmpty():
        hot = sized(hot)
        copies = sized_rows.join(hot, "hash", "left_semi").groupBy("record", "hash", "bytes", "shard").agg(F.count(F.lit(1)).alias("n"))
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("hash", F.xxhash64("hash", "copy"))
        sized_rows = sized_rows.join(hot, "hash", "left_anti").unionByName(copies.select("record", "hash", "bytes", "shard"))
    per_shard = cut(sized_rows.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / bucket_bytes)).cast("long").alias("buckets")))
    scattered = sized_rows.join(sized(per_shard), "shard").select("shard", F.pmod("hash", "buckets").alias("bucket"), "record")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = scattered.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = cut(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start")))
    # Rows sorted before they are shuffled: their order on arrival, which varies, doesn't count.
    mixed = scattered.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("record")).alias("rows")).select("shard", "bucket", F.shuffle("rows", F.lit(seed + 2)).alias("rows"))
    rows = mixed.join(sized(starts), ["shard", "bucket"]).select("shard", "bucket", "start", F.posexplode("rows").alias("at", "record"))
    grown = shard_of(F.col(f"record.`{key}`"), n_shards + 1, seed)
    return rows.select("record.*", "shard", "bucket", (F.col("start") + F.col("at")).alias("slot"), grown.alias("grown_shard"))


def write_shards(records: DataFrame, path: str, **how) -> None:
    """Both passes, the second one to disk: a folder of Parquet for each shard, in files of whole buckets, rows in order of slots."""
    shuffled_shards(records, **how).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What write_shards wrote: like's columns, shard, bucket, slot and grown_shard. An empty table, of which nothing was written, gives none."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.drop("shard", "bucket", "slot", "grown_shard").schema.fields)
    return spark.read.schema(f"{kinds}, bucket long, slot long, grown_shard int, shard int").parquet(path)
