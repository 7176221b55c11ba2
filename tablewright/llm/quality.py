"""Document rules and host rules: failures per host, rates shrunk with a beta prior, verdicts joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import WHITE, cut, key_of, let, sized, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _repeated_words(w: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        n = F.size(hashes)
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def of_sorted(s: Column) -> Column:
            twice = F.filter(F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"])), lambda i: i.isNotNull())
            return F.aggregate(F.sort_array(twice), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).otherwise(let(F.sort_array(at), of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, covered))


def document_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"), _repeated_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    of_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.withColumns({"__words": of_words, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": of_lines.cast("long")})
    out = out.withColumns({c: F.col(f"__words.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("__words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Per host: documents, failures, the failure rate drawn towards the prior, and whether the host is rejected.

    The prior is a beta distribution whose mean is the share of failures among all documents and whose weight follows from the
    variance of the hosts' rates, between 1 and a million documents.
    """
    hosts = judged.groupBy(key_of(F.col(host)).alias("host_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = hosts.withColumn("rate", F.col("failed") / F.col("n"))
    mean, var = F.sum("failed") / F.sum("n"), F.var_pop("rate")
    weight = F.when(var > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), mean * (1 - mean) / var - 1))).otherwise(F.lit(1e6))
    prior = hosts.agg(F.struct(mean.alias("mean"), weight.alias("weight")).alias("prior")).scalar()
    hosts = hosts.withColumn("prior", prior)
    shrunk = (F.col("failed") + F.col("prior.mean") * F.col("prior.weight")) / (F.col("n") + F.col("prior.weight"))
    return hosts.select("host_key", "n", "failed", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("host_rejected"))


def judge_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the carried columns, the features, base_failed, host_rejected, shrunk_rate and kept.

    A document is kept unless it fails by itself or its host's shrunk failure rate is over max_rate. A null or empty text has no
    words and fails. A null host is a host of its own. Repeated rows are judged row by row and all of them count for their host.
    An empty table gives an empty result. Columns of docs beside the carried ones are not read; carried ones named like a result are
    replaced by it. Texts of any length count whole.
    """
    thin = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(carry)], F.col(host).alias("__host"), F.col(text).alias("__text"))
    judged = cut(document_features(thin, "__text").drop("__text"))
    verdicts = host_verdicts(judged, "__host", max_rate)
    out = judged.withColumn("host_key", key_of(F.col("__host"))).join(verdicts.select("host_key", "shrunk_rate", "host_rejected"), "host_key", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host_key", "__host")


def keep_documents(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that judge_documents keeps; cases as there."""
    thin = docs.select(F.col(host).alias("__host"), F.col(text).alias("__text"))
    verdicts = host_verdicts(cut(document_features(thin, "__text").select("__host", "base_failed")), "__host", max_rate)
    rejected = cut(verdicts.where("host_rejected").select("host_key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"), key_of(F.col(host)).alias("host_key"))
    good = document_features(rows, "__text").where(~F.col("base_failed"))
    return good.join(sized(rejected), "host_key", "left_anti").select("__row.*")
