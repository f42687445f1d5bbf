"""Language identification by rank-order n-gram profiles (operator 8).

A language's profile is its most frequent character n-grams in order, learned
from all training documents.  A document's own most frequent n-grams are compared
with each profile by the out-of-place distance: how far each n-gram stands from
its rank in the profile, and the greatest distance if it is absent there.

Defined results: a null text, or one without letters, is ``und`` with score 0;
ties between languages go to the first in name order; ties between n-grams to the
smaller code; rows without a language teach nothing; with nothing learned every
text is ``und``; repeated rows are each predicted; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import slices

PROFILE = 400  # n-grams kept of a language and compared of a document
LONGEST = 3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of anything else is one 32."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[cp]
    cp = np.where(is_letter, cp, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of a run of others stays
    cp = cp[keep]
    return np.concatenate([[np.uint32(32)], cp, [np.uint32(32)]]).astype(np.uint64)


def ngrams(text: str, longest: int = LONGEST) -> np.ndarray:
    """All n-grams (up to three characters of 21 bits) that hold a letter and no inner gap."""
    c = codes(text)
    out = [c[c != 32]]
    if len(out[0]) == 0:
        return out[0]
    key = c
    for n in range(2, longest + 1):
        key = (key[:-1] << np.uint64(21)) | c[n - 1:]
        inner = c[1:-1] if n == 3 else None
        out.append(key if inner is None else key[inner != 32])
    return np.concatenate(out)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.diff(np.concatenate([head, [len(keys)]]))


def most_frequent(keys: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` commonest keys in order (ties: smaller key first; keys come sorted)."""
    if len(keys) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        some = np.flatnonzero(n >= least)
        keys, n = keys[some], n[some]
    return keys[np.argsort(-n, kind="stable")[:most]]


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows given; tasks count their own shards before the shuffle."""
    schema = "lang string, gram long, n long"

    def count(batches):
        for batch in slices(batches, text_col, 16 << 20):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(ngrams(text))
            for lang, grams in by.items():
                k, n = counted(np.concatenate(grams))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"])

    part = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias(text_col))
    return part.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = PROFILE) -> dict:
    """{lang: its ``most`` commonest n-grams in order}: a few kilobytes a language."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (gram_counts(docs, lang_col, text_col).withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= most))
    profiles: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranks:
    """The profiles' n-grams in one sorted list, with each language's rank of each (``most`` if absent)."""

    def __init__(self, profiles: dict[str, list], most: int):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.most = most
        self.rank = np.full((len(self.langs), len(self.grams) + 1), most, np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, np.array(profiles[lang], np.uint64))] = np.arange(
                len(profiles[lang]))

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        keys, n = counted(ngrams(text))
        if len(keys) == 0:
            return UNKNOWN, 0.0
        own = most_frequent(keys, n, self.most)
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        rank = self.rank[:, np.where(known, at, len(self.grams))]
        far = np.where(rank == self.most, self.most, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.most * len(own))


def identify(docs: DataFrame, profiles: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (),
             most: int = PROFILE) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``lang_pred`` and ``score`` (1 minus the share of the greatest distance)."""
    cols = [id_col, *keep]
    schema = T.StructType([*[docs.schema[c] for c in cols], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def judge(batches):
        ranks = Ranks(profiles, most)
        for batch in batches:
            found = [ranks.judge(t) for t in batch.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(cols))], pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=[f.name for f in schema.fields])

    return docs.select(*cols, F.col(text_col).cast("string").alias("__text")).mapInArrow(judge, schema)
