"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade <= j | x) = sigmoid(theta_j - w.x), with one weight vector w over hashed words
and ratios of form, and ascending thresholds theta. So one fit gives the expected grade and
the tail probabilities that selection needs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
#: The fit sees at most this many labelled rows, those with the smallest hashed ids.
SAMPLE = 8_000
EPOCHS = 8
RATE = 0.1
DECAY = 1e-5
#: A bucket counts if this share of the sample's texts, and five at least, have it.
LEAST_SHARE = 0.002
#: Features of a text's form, beside the hashed words.
FORM = 8


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thetas: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - score[:, None], -40, 40)))


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = FORM + xxhash.xxh3_64_intdigest(word.strip(".,;:!?|\"'()")) % (BUCKETS - FORM)
        return got


class Hasher:
    def __init__(self):
        self.buckets = _Buckets()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending indexes and their values: ratios of upper case, punctuation, symbols,
        repeats and length, then 1 for each bucket that a word falls in."""
        text = text or ""
        words = text.lower().split()
        n = max(1, len(words))
        chars = max(1, len(text))
        upper = sum(map(str.isupper, text.split()))
        form = np.array([1.0, upper / n, text.count("!") / n, text.count("|") / n, 1 - len(set(words)) / n, min(4.0, np.log10(n)), chars / n / 10, sum(map(text.count, "#*$%&<>")) / n])
        at = np.unique(np.fromiter(map(self.buckets.__getitem__, words), np.int64, len(words)))
        return np.concatenate([np.arange(FORM), at]), np.concatenate([form, np.ones(len(at))])


def _features(batches):
    h = Hasher()
    for b in batches:
        at, value = [], []
        for t in b.column(0):
            i, v = h(t.as_py())
            at.append(i.astype(np.int32))
            value.append(v.astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), b.column(1), b.column(2)], names=["at", "value", "grade", "o"])


def fit(labelled: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows with a grade in 0 .. grades-1; others are not used.

    ``labelled`` should be bounded already, as what ``graded`` gives. Features are computed
    on the executors; the driver gets them. AdaGrad over the rows from a shuffle of the
    order of their hashed ids, so a fit on the same rows gives the same model. Without
    rows, the weights are 0 and the thresholds even.
    """
    ok = labelled.filter(F.col(grade_col).between(0, grades - 1) & F.col(id_col).isNotNull())
    rows = ok.select(F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade"), _order(id_col).alias("o"))
    got = rows.mapInArrow(_features, "at array<int>, value array<float>, grade int, o long").toArrow().sort_by([("o", "ascending"), ("grade", "ascending")])[:sample]
    grade = got.column("grade").to_numpy().copy()
    flat = got.column("at").combine_chunks().flatten().to_numpy()
    counts = np.bincount(flat, minlength=BUCKETS) >= max(5, LEAST_SHARE * len(grade))
    counts[:FORM] = True
    at, value = [], []
    for i, v in zip(got.column("at"), got.column("value")):
        i = i.values.to_numpy()
        keep = counts[i]
        at.append(i[keep])
        value.append(v.values.to_numpy()[keep].astype(np.float64))
    del got, flat  # the driver holds the kept features only
    pa.default_memory_pool().release_unused()
    w, theta = np.zeros(BUCKETS), np.linspace(-1.0, 1.0, grades - 1)
    g_w, g_t = np.full(BUCKETS, 1e-2), np.full(grades - 1, 1e-2)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(grade)):
            i, v, g = at[k], value[k], grade[k]
            s = 1 / (1 + np.exp(np.clip(w[i] @ v - theta, -40, 40)))  # P(grade <= j)
            low, high = (s[g - 1] if g else 0.0), (s[g] if g < grades - 1 else 1.0)
            p = max(high - low, 1e-9)
            d_high = high * (1 - high) / p if g < grades - 1 else 0.0
            d_low = low * (1 - low) / p if g else 0.0
            step = (d_high - d_low)  # of -log p by w.x
            grad = step * v + DECAY * w[i]
            g_w[i] += grad**2
            w[i] -= RATE * grad / np.sqrt(g_w[i])
            t = np.zeros(grades - 1)
            if g < grades - 1:
                t[g] -= d_high
            if g:
                t[g - 1] += d_low
            g_t += t**2
            theta = np.maximum.accumulate(theta - RATE * t / np.sqrt(g_t))
    return Model(w.astype(np.float32), theta)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, tails (array: P(grade >= 1), P(grade >= 2), ...). A null text is
    an empty one; rows are kept one to one; other columns are not read."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        h, m = Hasher(), shared.value
        for b in batches:
            s = np.array([float(m.weights[i] @ v) for i, v in map(h, b.column(1).to_pylist())]) if b.num_rows else np.zeros(0)
            tails = m.tails(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=["id", "expected_grade", "tails"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, expected_grade double, tails array<double>").withColumnRenamed("id", id_col)


def _order(id_col: str):
    return F.xxhash64(F.col(id_col).cast("string"))


def graded(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled documents with a grade, ``sample`` at most: 0 toxic, 1 of low quality, 2 fine.

    A toxic document is the worst whatever its quality; a null label makes no grade; of
    several labels of a document the worst holds; other columns are not read. The
    sample is taken from ids alone, so that only its texts are moved.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, F.when(F.col("toxic") == 0, 1)).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    known = labels.select(F.col("doc_id").alias("_label_id"), grade.alias("_grade")).filter("_grade IS NOT NULL AND _label_id IS NOT NULL").groupBy("_label_id").agg(F.min("_grade").alias("_grade"))
    there = known.join(documents.select(F.col("doc_id").alias("_label_id")), "_label_id", "left_semi")
    chosen = there.orderBy(_order("_label_id"), "_label_id").limit(sample)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id")).select("doc_id", "text", F.col("_grade").alias("grade"))


#: A document is rejected where fine is less likely than this.
LEAST_FINE = 0.4


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_FINE) -> DataFrame:
    """id, expected_grade (0 to 2), p_not_toxic, p_fine, kept: every row of ``df``, with a
    model fitted on those with labels. An empty table gives no rows."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = score(docs, fit(graded(docs, labels), 3))
    p = F.round(F.col("tails")[1], 6)
    return out.select(F.col("doc_id").alias(id_col), F.round("expected_grade", 6).alias("expected_grade"), F.round(F.col("tails")[0], 6).alias("p_not_toxic"), p.alias("p_fine"), (p >= least).alias("kept"))
