"""Language identification: averaged embeddings of hashed subwords, a linear softmax trained by stochastic gradient descent in
numpy, and calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import cut, ship, sized

BUCKETS, DIM = 1 << 14, 16
LETTER = regex.compile(r"\p{L}")
#: Of a document's subwords at most so many are hashed at once; longer texts are worked through in parts, whole.
PART = 1 << 20


def subword_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords and their counts: one to four bytes of the lower-cased text, words set off by spaces."""
    total = np.zeros(BUCKETS, np.int64)
    raw = (" " + text.lower() + " ").encode()
    for at in range(0, len(raw), PART):
        b = np.frombuffer(raw[max(0, at - 3) : at + PART], np.uint8).astype(np.uint32)
        skip = min(3, at)  # what the part before has counted
        h = b.copy()
        for k in range(1, 5):
            if k > 1:
                h = h[:-1] * np.uint32(0x01000193) + b[k - 1 :] + np.uint32(k)
            mixed = (h * np.uint32(0x9E3779B1)) >> np.uint32(18)
            total += np.bincount(mixed[max(0, skip - k + 1) :], minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


@dataclass
class Model:
    """languages in order of text; scores: one row per bucket, what its embedding adds to each language's score."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str) -> tuple[int, float]:
        used, n = subword_counts(text)
        z = (n @ self.scores[used] / n.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return int(p.argmax()), float(p.max())


def _logits(e: np.ndarray, w: np.ndarray, bias: np.ndarray, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x[1] @ e[x[0]]) @ w + bias


def train(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 1.0, seed: int = 5, accepted: float = 0.99) -> Model:
    """rows: (text, language). A fifth of them sets the temperature, by the likelihood of the right language, and the score below
    which a prediction is rejected: the least one that leaves a share `accepted` of right ones among those at or above it."""
    languages = sorted({lang for _, lang in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    e, w, bias = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(languages))), np.zeros(len(languages))
    data = []
    for text, lang in rows:
        used, n = subword_counts(text)
        data.append(((used, n / n.sum()), index[lang]))
    held, fitted = data[::5], [x for i, x in enumerate(data) if i % 5] or data
    steps, done = epochs * len(fitted), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fitted)):
            (used, share), y = fitted[i]
            hidden = share @ e[used]
            z = hidden @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            now = rate * (1 - done / steps)
            back = w @ p
            w -= now * np.outer(hidden, p)
            bias -= 0.1 * now * p
            e[used] -= now * 5 * np.outer(share, back)  # an average gives each of many subwords little of the step
            done += 1
    z = np.array([_logits(e, w, bias, x) for x, _ in held]).reshape(-1, len(languages))
    y = np.array([lang for _, lang in held], int)

    def likelihood(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())

    temperature = max(np.geomspace(0.3, 20, 61), key=likelihood) if len(y) else 1.0
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    order = np.argsort(-p.max(1, initial=0), kind="stable")
    right = (p.argmax(1) == y)[order].cumsum() / np.arange(1, len(y) + 1) if len(y) else np.array([])
    good = np.flatnonzero(right >= accepted)
    threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return Model(languages, (e @ w).astype(np.float64), bias, float(temperature), min(threshold, 1.0))


def training_rows(docs: DataFrame, per_language: int = 1000, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 200_000) -> list[tuple[str, str]]:
    """A sample of about per_language labelled texts of each language, at most twice as many, chosen by a hash of the key.

    Every language takes part. If there are so many that the sample would be over `most` rows, each gets fewer, one on average at
    least.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = cut(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")))
    n = counts.count()
    each = max(1, min(per_language, most // max(n, 1)))
    hashed = F.pmod(F.xxhash64(F.lit(11), F.col("k").cast("string")), F.lit(1_000_000))
    drawn = labelled.join(sized(counts), "l").where(hashed < F.lit(each * 1e6) / F.col("n"))
    rows = drawn.select("t", "l").limit(2 * each * n).collect() if n else []
    return sorted([(r["t"], r["l"]) for r in rows if LETTER.search(r["t"])])


def predict(docs: DataFrame, model: Model | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score (0 to 1) and rejected (score under the calibrated threshold).

    A text that is null or has no letter, and every text if nothing was learned, gets und, score 0 and rejected. Whole texts count,
    of any length. Equal texts get equal results. An empty table gives an empty result; columns not carried are not read. A carried
    column that has the name of an output is an error.
    """
    if clash := set(carry) & {"lang_pred", "score", "rejected"}:
        raise ValueError(f"columns named like outputs: {sorted(clash)}")
    ship(docs.sparkSession)
    fields = {f.name: f for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(batch.num_columns - 1):
                t = x.as_py()
                if model is None or not t or not LETTER.search(t):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    i, p = model.predict(t)
                    langs.append(model.languages[i])
                    scores.append(p)
            rejected = [la == "und" or p < model.threshold for la, p in zip(langs, scores, strict=True)]
            columns = [batch.column(i) for i in range(len(carry))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "lang_pred", "score", "rejected"])

    schema = ", ".join([f"`{c}` {fields[c].dataType.simpleString()}" for c in carry] + ["lang_pred string, score double, rejected boolean"])
    return docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("__text")).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = 1000, folds: int = 5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """predict() by a model learned from the labelled rows outside fold 0, with held_out for the rows in it.

    A row's fold is crc32 of its doc_id as text, modulo folds; a null doc_id belongs to no fold, is never learned from, and its
    held_out is false.
    """
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % folds
    rows = training_rows(docs.where(fold != 0), per_language)
    model = train(rows) if rows else None
    out = predict(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), model, carry=(*carry, "held_out"))
    return out
