"""Toxicity from character n-grams scaled by naive Bayes log-count ratios (operator 11).

A text, lower-cased and with white space runs made one space, is a bag of its
character n-grams (``SIZES``), hashed into ``2 ** BITS`` buckets.  Each count is
multiplied by the bucket's log-count ratio: how much likelier the bucket is in
toxic than in other training texts.  The vector is divided by the length of the
plain count vector, a logistic regression is fitted on it, and a logistic curve
fitted on a fold of its own turns the linear form into the score.

Learning uses bounded samples of the labelled rows (documented parameters): the
ratios count at most ``COUNTED`` documents, chosen by the smallest hash of their
id; the weights are fitted on at most ``FITTED`` of these for each label and
``GRAMS`` different n-grams in all.  Scoring covers every whole text.

Defined results: a null or empty text is one space and has no n-grams, so its
score is the curve at the intercept; with nothing to learn from (no labels, or
one kind only) every score is 0.5; repeated rows are each scored; a document with
several labels teaches its highest one, and a repeated labelled row teaches once
each; null ids and null labels teach nothing; other columns are carried through
untouched, except those that this operator adds (``OUT``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import slices, written

SIZES = (4, 5, 6)
BITS = 18
COUNTED = 20_000  # labelled documents counted for the ratios, at most
FITTED = 1_000  # of these, documents of each label that the weights are fitted on, at most
GRAMS = 4_000_000  # different n-grams of those documents in all, at most (documents are taken until then)
THRESHOLD = 0.7
STEPS = 120
PENALTY = 1e-4
CHUNK = 2 << 20  # bytes of text hashed at a time
DOCS = 1 << 13  # and texts

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC4CEB9FE1A85EC53)

OUT = [("score", T.DoubleType()), ("predicted", T.IntegerType())]


def buckets(texts: list[str | None], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of all texts' n-grams, ascending by text and bucket.

    The texts stand in one sequence, each between two spaces and ended by a zero;
    windows over a zero do not count.
    """
    whole = "".join(f" {' '.join(t.lower().replace(chr(0), ' ').split())} \0" if t else " \0" for t in texts)
    cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(cp == 0)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[-1], ends])))
    left = ends[doc] - np.arange(len(cp))  # characters from here to the text's end
    found = []
    h = np.zeros(len(cp), np.uint64)
    for n in range(1, max(sizes) + 1):
        h = h[:max(0, len(cp) - n + 1)] * _BASE + cp[n - 1:] + np.uint64(1)
        if n in sizes and len(h):
            at = np.flatnonzero(left[:len(h)] >= n)
            b = ((h[at] + np.uint64(n)) * _SPREAD) >> np.uint64(64 - BITS)
            found.append((doc[at].astype(np.uint32) << np.uint32(BITS)) | b.astype(np.uint32))
    key = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint32)
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([head, [len(key)]]))
    key = key[head]
    return (key >> np.uint32(BITS)).astype(np.int64), (key & np.uint32((1 << BITS) - 1)).astype(np.int64), n


def pieces(batches, text_col: str):
    """Batches of bounded text and number of rows."""
    for batch in slices(batches, text_col, CHUNK):
        for at in range(0, batch.num_rows, DOCS):
            yield batch.slice(at, DOCS)


def scaled(doc: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    """Counts divided by the length of their text's count vector."""
    size = np.sqrt(np.bincount(doc, n.astype(np.float64) ** 2, minlength=docs))
    return n / np.maximum(size, 1e-9)[doc]


def ratios(toxic: np.ndarray, other: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratio of each bucket."""
    p, q = toxic + smooth, other + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def curve(z: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve of balanced classes by Newton's method, with targets kept off 0 and 1."""
    pos, neg = label.sum(), (1 - label).sum()
    y = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(label == 1, 0.5 / pos, 0.5 / neg) * len(z)
    mid, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mid) / spread, np.ones_like(z)], axis=1)
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * theta), -5, 5)
    return float(theta[0] / spread), float(theta[1] - theta[0] * mid / spread)


class Model:
    """One weight a bucket (ratio times regression weight), the intercept and the curve."""

    def __init__(self, weight: np.ndarray, bias: float, a: float, b: float):
        self.weight, self.bias, self.a, self.b = weight, bias, a, b

    def linear(self, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
        return np.bincount(doc, scaled(doc, n, docs) * self.weight[bucket], minlength=docs) + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, bucket, n = buckets(texts)
        z = self.linear(doc, bucket, n, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))


def fit(ratio: np.ndarray, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, label: np.ndarray,
        fold: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    """Weights by gradient steps on the texts outside ``fold``, the curve on those in it (on all, if it lacks a label)."""
    x = (scaled(doc, n, len(label)) * ratio[bucket]).astype(np.float32)
    # the same entries by text and by bucket, so that both sums run over neighbours
    turned = np.argsort(bucket, kind="stable")
    by_bucket = bucket[turned]
    first = np.flatnonzero(np.concatenate([[True], by_bucket[1:] != by_bucket[:-1]])) if len(turned) else turned
    used = by_bucket[first]
    x_turned, doc_turned = x[turned], doc[turned]
    row = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
    teach = ~fold if len(set(label[~fold])) == 2 else np.ones(len(label), bool)
    share = np.where(label == 1, 0.5 / max(1, (label[teach] == 1).sum()), 0.5 / max(1, (label[teach] == 0).sum())) * teach
    full, bias = np.zeros(len(ratio), np.float32), 0.0
    w = np.full(len(used), 0.1)

    def linear():
        full[used] = w
        z = np.full(len(label), bias)
        if len(row):
            z[doc[row]] += np.add.reduceat(x * full[bucket], row)
        return z

    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        g = ((1 / (1 + np.exp(-np.clip(linear(), -30, 30))) - label) * share).astype(np.float32)
        pull = np.add.reduceat(x_turned * g[doc_turned], first) if len(first) else np.zeros(0)
        grad = np.append(pull + penalty * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    z = linear()
    held = fold if len(set(label[fold])) == 2 else np.ones(len(label), bool)
    a, b = curve(z[held], label[held])
    weight = np.zeros(len(ratio))
    weight[used] = w * ratio[used]
    return Model(weight, bias, a, b)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(at, label, text) of at most ``most`` labelled documents, those with the smallest hash of their id."""
    of = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
          .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
          .join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
          .withColumn("at", F.xxhash64("__id")).orderBy("at", "__id").limit(most))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(of), "__id").select("at", "label", "text")  # at most `most` rows of numbers


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", counted: int = COUNTED, fitted: int = FITTED, grams: int = GRAMS) -> Model | None:
    """The model learned from the labelled rows of ``docs`` (bounds above); None with fewer than two kinds of label."""
    rows = written(sample(docs, labels, id_col, text_col, label_col, counted), "toxicity-sample")
    both = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if both["low"] == both["high"]:
        return None

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in pieces(batches, "text"):
            label = np.minimum(batch.column(1).to_numpy(zero_copy_only=False), 1)
            doc, bucket, n = buckets(batch.column(2).to_pylist())
            for k in (0, 1):
                mine = label[doc] == k
                total[k] += np.bincount(bucket[mine], n[mine], minlength=1 << BITS).astype(np.int64)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1][at]), pa.array(total[0][at])],
                                         names=["bucket", "toxic", "other"])

    # one row a bucket, 2 ** BITS at most
    sums = rows.mapInArrow(count, "bucket long, toxic long, other long").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    toxic, other = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = sums.column("bucket").to_numpy()
    toxic[at], other[at] = sums.column("toxic").to_numpy(), sums.column("other").to_numpy()

    def bags(batches):
        for batch in pieces(batches, "text"):
            doc, bucket, n = buckets(batch.column(2).to_pylist())
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([bucket[a:z].astype(np.uint32).tobytes() for a, z in zip(cut, cut[1:])], pa.binary()),
                 pa.array([n[a:z].astype(np.uint32).tobytes() for a, z in zip(cut, cut[1:])], pa.binary())],
                names=["at", "label", "buckets", "counts"])

    place = F.row_number().over(Window.partitionBy(F.col("label") > 0).orderBy("at", F.xxhash64("text")))
    chosen = rows.withColumn("place", place).filter(F.col("place") <= fitted).orderBy("place", "label")
    ids, label, fold, size = [], [], [], 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for r in chosen.select("at", "label", "text").mapInArrow(
            bags, "at long, label int, buckets binary, counts binary").toLocalIterator():
        parts.append((np.frombuffer(r["buckets"], np.uint32), np.frombuffer(r["counts"], np.uint32)))
        label.append(1 if r["label"] else 0)
        fold.append(r["at"] % 4 == 0)
        ids.append(len(parts[-1][0]))
        size += ids[-1]
        if size >= grams:
            break
    label = np.array(label, np.int64)
    if len(set(label.tolist())) < 2:
        return None
    return fit(ratios(toxic, other), np.repeat(np.arange(len(ids), dtype=np.int32), ids),
               np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts]),
               label, np.array(fold, bool))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (1: toxic) and ``predicted``."""
    base = docs.drop(*[c for c, _ in OUT])
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, t) for c, t in OUT]])

    def judge(batches):
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            s = np.full(len(texts), 0.5) if model is None else model.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[f.name for f in schema.fields])

    return base.mapInArrow(judge, schema)
