"""WARC archives on any file system that Spark writes to, and their reading back by boundary-chain verification.

Reading: the archive is cut at every place that looks like the begin of a record. Each cut is a candidate that names its successor
by its Content-Length. Pointer jumping from the begin of each file marks what the true chain reaches; what only looks like a
record, inside some payload, is never reached.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import cut, remove, shared_dir, ship

MAGIC, GAP = "WARC/1.0\r\n", "\r\n\r\n"
LEAST_BYTES = 1000
#: A list of repeated payloads of at most so many rows of about 80 bytes is sent to all executors; a longer one is joined by shuffle.
BROADCAST_ROWS = 50_000


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest (SHA-1) and refers_to, which is null but for revisits.

    Of equal payloads of at least 1000 bytes the row with the largest key is the response and the others refer to it; rows that
    share this key are all responses. A null payload is an empty one. A null key is smaller than any other.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    full = pages.select(F.col(key).alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    full = full.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    thin = full.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id"))
    again = cut(thin.where((F.col("n") > 1) & F.col("response_id").isNotNull()).drop("n"))
    again = F.broadcast(again) if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else again
    out = full.join(again, ["payload_digest", "payload_bytes"], "left")
    same = F.col("page_id").eqNullSafe(F.col("response_id"))
    return out.withColumn("refers_to", F.when(~same, F.col("response_id"))).drop("response_id")


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", payload: str = "html") -> None:
    """One uncompressed archive for each task, written by Spark's own text sink, which ends every record with an empty line."""
    p = with_revisits(pages, key, payload)
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        _header("WARC-Refers-To", urn(F.col("refers_to"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(GAP),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    p.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _field(name: str, pattern: str = r"([^\r\n]*)") -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}: *{pattern}", 1)


def _candidates(spark: SparkSession, path: str, keep_body: bool = False) -> DataFrame:
    """A row for each piece between two places that look like a begin: file, block, order, lengths, header fields, digest."""
    pieces = spark.read.option("lineSep", GAP + MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = pieces.withColumns({"seq": F.monotonically_increasing_id(), "n": F.octet_length("value").cast("long")})
    first = (F.col("block") == 0) & F.startswith(F.col("value"), F.lit(MAGIC))
    body = pieces.withColumn("body", F.when(first, F.substring(F.col("value"), F.lit(len(MAGIC) + 1), F.length("value"))).otherwise(F.col("value")))
    body = body.withColumn("head", F.substring_index("body", GAP, 1))  # all of it if the cut is where the header ends
    body = body.withColumns({"head_bytes": F.octet_length("head").cast("long"), "length": F.expr(r"try_cast(regexp_extract(head, '(?im)^Content-Length: *([0-9]+)', 1) AS bigint)")})
    inside = F.substring(F.col("body").cast("binary"), (F.col("head_bytes") + len(GAP) + 1).cast("int"), F.col("length").cast("int"))
    out = body.select(
        "file", "block", "seq", "n", "head_bytes", "length", first.alias("first"), F.xxhash64("value").alias("hash"),
        F.sha1(inside).alias("digest"), F.octet_length(inside).cast("long").alias("got"),
        F.lower(_field("WARC-Type")).alias("record_type"), F.expr(r"try_cast(regexp_extract(head, '(?im)^WARC-Record-ID: *<urn:page:([^>]*)>', 1) AS bigint)").alias("page_id"),
        F.expr(r"try_cast(regexp_extract(head, '(?im)^WARC-Refers-To: *<urn:page:([^>]*)>', 1) AS bigint)").alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("declared"), F.expr(r"try_cast(regexp_extract(head, '(?im)^WARC-Payload-Length: *([0-9]+)', 1) AS bigint)").alias("full_length"),
        *([F.col("value")] if keep_body else []),
    )
    return out


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """Where each piece's record begins in its file: sums of lengths within a block, then over the blocks of a file."""
    step = F.col("n") + len(GAP + MAGIC)
    inner = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    outer = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(outer), F.lit(0)).alias("before"))
    out = pieces.withColumn("local", F.coalesce(F.sum(step).over(inner), F.lit(0))).join(blocks, ["file", "block"])
    start = F.col("before") + F.col("local")
    at = F.when(start > 0, start - len(MAGIC)).when(F.col("first"), F.lit(0)).otherwise(F.lit(-1))
    out = out.withColumns({"at": at.cast("long"), "length": F.when(~F.col("first") | (start == 0), F.col("length")), "first": F.col("first") & (start == 0)})
    return out.drop("before", "local")


def _exits(rows: pa.Table) -> pa.Table:
    """Of one block's candidates: where each one's chain leaves the block, null if it breaks off inside."""
    at, nxt = rows.column("at").to_pylist(), rows.column("next").to_pylist()
    last, to = max(at), {}
    for x, y in sorted(zip(at, nxt, strict=True), reverse=True):
        to[x] = to.get(y) if y <= last else y
    return pa.table([rows.column("file").combine_chunks(), rows.column("at").combine_chunks(), pa.array([to[x] for x in at], pa.int64())], ["file", "at", "jump"])


def _followed(rows: pa.Table) -> pa.Table:
    """Of one block's candidates those that a chain reaches that enters the block at a marked one."""
    at, nxt, entry = (rows.column(c).to_pylist() for c in ("at", "next", "entry"))
    on = {x for x, e in zip(at, entry, strict=True) if e}
    for x, y in sorted(zip(at, nxt, strict=True)):
        if x in on:
            on.add(y)
    keep = [x in on for x in at]
    return rows.select(["file", "at"]).filter(pa.array(keep, pa.bool_()))


def reachable(links: DataFrame) -> DataFrame:
    """Of links (file, block, at, next) those (file, at) that the chain from offset 0 of their file reaches, by pointer jumping.

    Within a block of a file each task follows its candidates to where they leave the block. Of these jumps, those from offset 0 or
    from where another jump ends take part in the rounds: in every round each place jumps twice as far as before, and what marked
    places jump to is marked. Then each block is followed from its marked places.
    """
    ship(links.sparkSession)
    jumps = cut(links.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(_exits, "file string, at long, jump long"))
    ends = jumps.where(F.col("jump").isNotNull()).select("file", F.col("jump").alias("at")).distinct()
    zero = jumps.where(F.col("at") == 0).select("file", "at", "jump", F.lit(True).alias("marked"))
    now = cut(zero.unionByName(jumps.where(F.col("at") > 0).join(ends, ["file", "at"], "left_semi").withColumn("marked", F.lit(False))))
    while not now.where(F.col("jump").isNotNull() & (F.col("at") > 0)).isEmpty():
        marks = now.where(F.col("marked") & F.col("jump").isNotNull()).select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        further = now.select("file", F.col("at").alias("jump"), F.col("jump").alias("jump2"))
        now = cut(now.join(marks, ["file", "at"], "left").join(further, ["file", "jump"], "left").select("file", "at", F.col("jump2").alias("jump"), (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked")))
    last = now.where(F.col("marked") & F.col("jump").isNotNull()).select("file", F.col("jump").alias("at"))
    entries = now.where("marked").select("file", "at").unionByName(last).distinct().withColumn("entry", F.lit(True))
    followed = links.select("file", "block", "at", "next").join(entries, ["file", "at"], "left")
    return followed.groupBy("file", "block").applyInArrow(_followed, "file string, at long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The true records: file, at (offset), page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact.

    payload_bytes and payload_digest are of the full payload, for revisits as the record states them. intact: the digest of what
    the archive holds is the stated one. An archive that doesn't begin with a record has none; after a broken record a file's
    chain ends. An empty folder gives an empty result.
    """
    pieces = cut(_with_offsets(_candidates(spark, path)))
    links = pieces.where((F.col("at") >= 0) & F.col("length").isNotNull())
    links = links.withColumn("next", F.col("at") + len(MAGIC) + F.col("head_bytes") + len(GAP) + F.col("length") + len(GAP))
    true = links.join(reachable(links), ["file", "at"], "left_semi")
    whole = cut(true)
    split = whole.where(F.col("got") < F.col("length"))
    out = whole.where(F.col("got") >= F.col("length"))
    if not split.isEmpty():  # their payloads hold what looks like a begin: put the pieces together again
        begins = whole.select("file", "at", F.col("at").alias("owner"))
        owned = pieces.join(begins, ["file", "at"], "left").withColumn("owner", F.last("owner", ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        parts = owned.join(split.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi").select("file", "owner", "at", "hash", "n", "first")
        bodies = _candidates(spark, path, True).join(parts.select("file", "hash", "n").distinct(), ["file", "hash", "n"], "left_semi").groupBy("file", "hash", "n").agg(F.first("value").alias("value"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), GAP + MAGIC)
        joined = parts.join(bodies, ["file", "hash", "n"]).groupBy("file", "owner").agg(text.alias("text"), F.max("first").alias("from_first"))
        joined = joined.select("file", F.col("owner").alias("at"), (F.octet_length("text") - F.length(F.lit(MAGIC)) * F.col("from_first").cast("int")).alias("have"), F.col("text").cast("binary").alias("raw"), "from_first")
        again = split.drop("digest", "got").join(joined, ["file", "at"])
        start = F.col("head_bytes") + len(GAP) + 1 + len(MAGIC) * F.col("from_first").cast("int")
        inside = F.substring(F.col("raw"), start.cast("int"), F.col("length").cast("int"))
        again = again.withColumns({"digest": F.sha1(inside), "got": F.octet_length(inside).cast("long")}).drop("raw", "have", "from_first")
        out = out.unionByName(again.where(F.col("got") >= F.col("length")))
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "file", "at", "page_id", "url", "record_type", "refers_to", F.when(revisit, F.col("full_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("declared")).otherwise(F.col("digest")).alias("payload_digest"), (revisit | (F.col("digest") == F.col("declared"))).alias("intact"),
    )


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """What read_archives finds in archives of pages written to the shared folder, which is removed afterwards."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, key=key, payload=payload)
    out = cut(read_archives(spark, path))
    remove(spark, path)
    return out
