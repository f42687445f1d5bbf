"""Document quality from a linear-chain conditional random field over lines (operator 2).

Every line of a document is labelled good or bad.  A line's features are taken
from its bytes and from the lines beside it; transitions tie neighbouring labels.
Forward-backward gives each line's marginal, the marginals weighted by line
length give the document's share of good text, and a logistic curve fitted on the
training documents turns that share into the score.

Learning uses a bounded sample of labelled documents (``SAMPLE``, those with the
smallest hash of their id), of which only line features, never texts, reach the
driver.  Scoring covers every whole text.

Defined results: a null or empty text is one empty line; with nothing to learn
from (no labels, or one kind only) every score is 0.5; repeated rows are each
scored; a document with several labels teaches its best one; other columns are carried
through untouched, except those that this operator adds (``OUT``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import giving_back, lists, put_aside, slices, text_buffer, word_hashes

SAMPLE = 3000  # labelled documents learned from, at most
SAMPLE_LINES = 100_000  # and of their lines, at most (documents are taken until then)
THRESHOLD = 0.3
STEPS = 150
PENALTY = 1e-3
CHUNK = 8 << 20

#: byte classes counted on each line
_CLASS = np.full(256, 0, np.uint8)
_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _MARK, _BAR = 1, 2, 3, 4, 5, 6, 7
for _c in range(256):
    _ch = chr(_c)
    if _c >= 128 or _ch.islower():
        _CLASS[_c] = _LETTER
    elif _ch.isupper():
        _CLASS[_c] = _UPPER
    elif _ch.isdigit():
        _CLASS[_c] = _DIGIT
    elif _ch in " \t\r\x0b\x0c":
        _CLASS[_c] = _SPACE
    elif _ch in ".,;:'\"?-()":
        _CLASS[_c] = _STOP
    elif _ch in "|/\\<>{}[]=_~^":
        _CLASS[_c] = _BAR
    elif 32 < _c < 127:
        _CLASS[_c] = _MARK  # ! # $ % & * + @ `
BASE = 12  # features of a line by itself
WIDTH = 3 * BASE + 3  # with those of the lines beside it, and whether they exist


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, weight of each line, number of lines of each text)."""
    buf, ends = text_buffer(col)
    docs = len(col)
    # one line feed after every text: each line then ends with one
    whole = np.insert(buf, ends[1:], 10) if docs else buf
    stops = np.flatnonzero(whole == 10)
    doc_stop = ends[1:] + np.arange(docs)
    n_lines = np.diff(np.concatenate([[0], np.searchsorted(stops, doc_stop, "right")]))
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    size = stops - starts
    cls = _CLASS[whole]

    def count(flag):
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (total[stops] - total[starts]).astype(np.float64)

    upper, space, mark, bar = (count(cls == k) for k in (_UPPER, _SPACE, _MARK, _BAR))
    letters, digits, points = count(cls == _LETTER), count(cls == _DIGIT), count(cls == _STOP)
    gap = (cls == _SPACE) | (whole == 10)
    begin = ~gap & np.concatenate([[True], gap[:-1]]) if len(whole) else gap
    at = np.flatnonzero(begin)
    word_line = np.searchsorted(stops, at, "left")
    finish = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) if len(whole) else at
    # words as hashes, to see repetition: equal to the word before, and few different ones
    codes = word_hashes(whole, at, finish + 1)
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (word_line[1:] == word_line[:-1])]) if len(at) else at
    lines = len(stops)
    n_words = np.bincount(word_line, minlength=lines).astype(np.float64)
    line_bits = np.uint64(max(20, lines.bit_length()))
    rest = np.uint64(64) - line_bits
    key = np.sort((codes >> line_bits) | (word_line.astype(np.uint64) << rest))
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    different = np.bincount((key[first] >> rest).astype(np.int64), minlength=lines)
    repeated = np.bincount(word_line[again.astype(bool)], minlength=lines) if len(at) else np.zeros(lines)
    chars, ws = np.maximum(size, 1), np.maximum(n_words, 1)
    cased = np.maximum(letters + upper, 1)
    own = np.stack([
        np.ones(lines), upper / cased, np.minimum(mark / ws, 4) / 2, np.minimum(bar / ws, 2), digits / chars,
        points / ws, repeated / ws, different / ws, np.minimum(n_words / 40, 2), np.log1p(size) / 8,
        np.minimum(size / ws, 40) / 10, (letters + upper) / chars], axis=1)
    own[size == 0, 1:] = 0
    head = np.zeros(lines, bool)
    tail = np.zeros(lines, bool)
    offs = np.concatenate([[0], np.cumsum(n_lines)])
    head[offs[:-1]] = True
    tail[offs[1:] - 1] = True
    prev = np.zeros_like(own)
    prev[1:] = own[:-1]
    prev[head] = 0
    nxt = np.zeros_like(own)
    nxt[:-1] = own[1:]
    nxt[tail] = 0
    x = np.concatenate([own, prev, nxt, head[:, None], tail[:, None], (head & tail)[:, None]], axis=1)
    return x.astype(np.float32), np.maximum(size, 1).astype(np.float64), n_lines


def marginals(state: np.ndarray, trans: np.ndarray, n_lines: np.ndarray):
    """Forward-backward over many chains at once: log Z, P(good) of each line, expected transitions.

    ``state`` is lines x 2 (bad, good), ``trans`` 2 x 2.  Chains advance together;
    each step touches the chains that still have lines.
    """
    offs = np.concatenate([[0], np.cumsum(n_lines)])[:-1]
    order = np.argsort(-n_lines, kind="stable")
    live_at = np.searchsorted(-n_lines[order], -np.arange(int(n_lines.max(initial=0))), "left")
    fwd, bwd = np.zeros_like(state), np.zeros_like(state)
    fwd[offs] = state[offs]
    for t in range(1, len(live_at)):
        i = offs[order[:live_at[t]]] + t
        before = fwd[i - 1]
        m = before.max(axis=1, keepdims=True)
        fwd[i] = state[i] + m + np.log(np.exp(before - m) @ np.exp(trans))
    for t in range(len(live_at) - 2, -1, -1):
        c = order[:live_at[t + 1]]  # chains with a line after t
        i = offs[c] + t
        after = state[i + 1] + bwd[i + 1]
        m = after.max(axis=1, keepdims=True)
        bwd[i] = m + np.log(np.exp(after - m) @ np.exp(trans).T)
    ends = offs + n_lines - 1
    top = fwd[ends].max(axis=1)
    log_z = top + np.log(np.exp(fwd[ends] - top[:, None]).sum(axis=1))
    z = np.repeat(log_z, n_lines)
    p = np.exp(fwd + bwd - z[:, None])
    inner = np.ones(len(state), bool)
    inner[ends] = False
    i = np.flatnonzero(inner)
    edge = np.exp(fwd[i][:, :, None] + trans[None] + (state[i + 1] + bwd[i + 1])[:, None, :] - z[i][:, None, None])
    return log_z, p[:, 1] / p.sum(axis=1), edge.sum(axis=0)


def share_of_good(good: np.ndarray, weight: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Mean marginal of each text, weighted by line length."""
    offs = np.concatenate([[0], np.cumsum(n_lines)])[:-1]
    return np.add.reduceat(good * weight, offs) / np.add.reduceat(weight, offs)


class Model:
    """Weights of the field (bad and good), transitions, and the document's logistic curve."""

    def __init__(self, mean, scale, weights, trans, curve):
        self.mean, self.scale, self.weights, self.trans, self.curve = mean, scale, weights, trans, curve

    def lines(self, x: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return marginals(((x - self.mean) / self.scale) @ self.weights, self.trans, n_lines)[1]

    def documents(self, share: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))


def fit(x: np.ndarray, weight: np.ndarray, n_lines: np.ndarray, label: np.ndarray, steps: int = STEPS,
        penalty: float = PENALTY) -> Model:
    """Maximum likelihood (gradient steps of adaptive size) with each line labelled as its document."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[scale < 1e-6], scale[scale < 1e-6] = 0, 1
    xs = ((x - mean) / scale).astype(np.float64)
    y = np.repeat(label, n_lines)
    ends = np.cumsum(n_lines)
    inner = np.ones(len(y), bool)
    inner[ends - 1] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i], y[i + 1]), 1)
    target = np.stack([1 - y, y], axis=1)
    theta = np.zeros(2 * WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(y)
    for t in range(1, steps + 1):
        w, trans = theta[:2 * WIDTH].reshape(WIDTH, 2), theta[2 * WIDTH:].reshape(2, 2)
        _, good, edges = marginals(xs @ w, trans, n_lines)
        p = np.stack([1 - good, good], axis=1)
        g = np.concatenate([(xs.T @ (p - target)).ravel(), (edges - seen).ravel()]) / n + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    w, trans = theta[:2 * WIDTH].reshape(WIDTH, 2), theta[2 * WIDTH:].reshape(2, 2)
    good = marginals(xs @ w, trans, n_lines)[1]
    return Model(mean, scale, w, trans, fit_curve(share_of_good(good, weight, n_lines), label))


def fit_curve(share: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic curve from share to label by Newton's method, with targets kept off 0 and 1."""
    good, bad = label.sum(), (1 - label).sum()
    y = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.stack([share, np.ones_like(share)], axis=1)
    theta = np.array([8.0, -4.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - y) + 1e-3 * theta)
        theta = theta - np.clip(step, -5, 5)
    return float(theta[0]), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model | None:
    """The model learned from at most ``sample`` labelled documents of ``docs`` and ``sample_lines`` of their lines.

    Documents of more than ``sample_lines // 10`` lines are left out.
    """
    of = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
          .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
          .join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
          .withColumn("__at", F.xxhash64("__id")).orderBy("__at", "__id").limit(sample))
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(
        F.broadcast(of), "__id").select("__id", "__text", "__label", "__at")  # at most `sample` rows of numbers
    schema = "x binary, weight binary, label int, n int, at long"

    def read(batches):
        for batch in slices(batches, "__text", CHUNK):
            x, weight, n_lines = line_features(batch.column(1))
            offs = np.concatenate([[0], np.cumsum(n_lines)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[a:z].tobytes() for a, z in zip(offs, offs[1:])], pa.binary()),
                 pa.array([weight[a:z].tobytes() for a, z in zip(offs, offs[1:])], pa.binary()),
                 batch.column(2).cast(pa.int32()), pa.array(n_lines, pa.int32()),
                 batch.column(3)], names=["x", "weight", "label", "n", "at"])

    rows, lines = [], 0
    for r in chosen.mapInArrow(read, schema).filter(F.col("n") <= sample_lines // 10).orderBy(
            "at", "n").toLocalIterator():
        rows.append(r)
        lines += r["n"]
        if lines >= sample_lines:
            break
    label = np.array([1 if r["label"] else 0 for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return None
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows])
    weight = np.concatenate([np.frombuffer(r["weight"], np.float64) for r in rows])
    return fit(x, weight, np.array([r["n"] for r in rows], np.int64), label)


OUT = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("bad_lines", T.ArrayType(T.IntegerType()))]


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (1: good), ``predicted`` and the numbers of its ``bad_lines``."""
    base = docs.drop(*[c for c, _ in OUT])
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, t) for c, t in OUT]])

    def judge(batches):
        for batch in slices(batches, text_col, CHUNK):
            x, weight, n_lines = line_features(batch.column(batch.schema.get_field_index(text_col)))
            if model is None:
                s, bad = np.full(len(n_lines), 0.5), np.zeros(len(weight), bool)
            else:
                good = model.lines(x, n_lines)
                s, bad = model.documents(share_of_good(good, weight, n_lines)), good < 0.5
            offs = np.concatenate([[0], np.cumsum(n_lines)])
            at = np.flatnonzero(bad)
            doc = np.searchsorted(offs, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)),
                 lists(pa.array((at - offs[doc]).astype(np.int32)), np.bincount(doc, minlength=len(n_lines)))],
                names=[f.name for f in schema.fields])

    return base.mapInArrow(giving_back(judge), schema)


def clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` that the classifier accepts, same columns (also those of the names that ``score`` adds)."""
    plain, back = put_aside(docs, [c for c, _ in OUT])
    return back(score(plain, model, text_col).filter("predicted = 1"))
