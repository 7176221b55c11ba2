"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and the controls from tab to carriage return.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
#: What is sent out to all executors holds so many bytes at most, as estimated from its rows.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, null for none; a null text has no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return let(trimmed, lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITE_RUN)))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where none is set and all runs on this machine, as in local tests."""
    sc = spark.sparkContext
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set; executors need a folder that all of them reach")
        found = f"file://{tempfile.mkdtemp(prefix='tablewright-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that nothing before them is computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """cut() for a loop: forgets what the plan was estimated to hold, too. Estimates multiply at joins; their digits double each time."""
    out, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(out._jdf.javaRDD(), out._jdf.schema()), spark)


def key_of(col: Column) -> Column:
    """A string that is never null and differs where the values differ: for joins in which null is a value."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Sends this package to executors that don't have it on their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(p.endswith("tablewright.zip") for p in sc.listFiles):
        return
    to = os.path.join(tempfile.mkdtemp(), "tablewright.zip")
    with zipfile.ZipFile(to, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "tablewright")):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(to)


def sized(small: DataFrame, rows: int = 500_000, weight: Column | None = None) -> DataFrame:
    """small marked for broadcast if it is so; else as it is, for a join by shuffle.

    Small is: no more than so many rows; or, with weight (a row's bytes, estimated), BROADCAST_BYTES at most.
    """
    if weight is None:
        return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small
    return F.broadcast(small) if (small.agg(F.sum(weight.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else small


def salted(rows: DataFrame, key: str, other: str, most: int) -> DataFrame:
    """rows with salt, which splits the rows of a key that has more than `most` by a hash of `other`; 0 for all other keys."""
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / most).alias("__n"))
    out = rows.join(sized(cut(hot)), F.col(key) == F.col("__hot"), "left")
    return out.withColumn("salt", F.pmod(F.xxhash64(F.lit(6), other), F.coalesce("__n", F.lit(1)))).drop("__hot", "__n")


def tidy(rows: Iterator) -> Iterator:
    """rows, and afterwards the worker's freed memory given back, so that an idle worker holds little."""
    yield from rows
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
