"""Ranked lexical search with a length-stratified index (operator 13).

A document's normaliser ``m`` depends only on its length, so documents fall into
strata of equal ``m``, and within a stratum a term's impact depends only on how
often a document holds it.  The index keeps, for each document, its stratum and
its postings of the terms asked for; it is dealt by ranges of (stratum, id), so
that a stratum of any size is spread over as many tasks as it needs.  A task
sorts its postings by (term, stratum, tf) and computes each impact once for each
such run.  The greatest tf of a term in a stratum bounds what the term can add
there; for each query the strata are visited in order of their summed bounds,
until the next bound lies below the score of the tenth document found so far.
Every document is indexed and nothing is skipped that could enter a result.

Queries are read in blocks of bounded size (``BLOCK_BYTES``), and each block makes
an index of its own terms.  Terms are compared by 64-bit hashes.

Defined results: a null text has no terms and is no document to N and L; each row
is a document of its own, also where ids or texts repeat; a null doc_id comes
after others of equal score; a query without terms has no rows; rows of one item
id are each answered; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import lists, parts_for, slices, text_buffer, word_hashes, written

TOP = 10
BLOCK_BYTES = 16 << 20  # of query text held by a task at a time
CHUNK = 8 << 20
SLICE = 1 << 20  # postings searched at a time, about
PART = 1 << 19  # postings of a task, about

_BYTE = np.zeros(256, np.uint8)  # lower-cased; 0 where no term byte
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128:
        _BYTE[_c] = _c
    elif 65 <= _c <= 90:
        _BYTE[_c] = _c + 32


def terms_of(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every term of texts that lie one after the other."""
    whole = np.insert(_BYTE[buf], ends[1:], 0)  # a gap after every text
    inside = np.concatenate([[0], (whole != 0).view(np.int8), [0]])
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(ends[1:] + np.arange(len(ends) - 1), start, "right")
    return text, word_hashes(whole, start, stop)


class Queries:
    """A block of queries: its terms' hashes in order, and each query's terms with how often it holds them."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        text, hashes = terms_of(*text_buffer(pa.array(texts, pa.string())))
        self.hashes, place = np.unique(hashes, return_inverse=True)
        cut = np.searchsorted(text, np.arange(len(ids) + 1))
        self.terms = [np.unique(place[a:z], return_counts=True) for a, z in zip(cut, cut[1:])]


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Queries]:
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"] or "")
        if size >= block_bytes:
            yield Queries(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts)


def postings(docs: DataFrame, hashes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) of every document with a term: its length and the numbers of its terms among ``hashes``."""

    def read(batches):
        for batch in slices(batches, "text", CHUNK):
            buf, ends = text_buffer(batch.column(1))
            text, found = terms_of(buf, ends)
            n = np.bincount(text, minlength=batch.num_rows)
            at = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
            known = np.flatnonzero(hashes[at] == found) if len(hashes) else np.zeros(0, np.int64)
            key, tf = np.unique(text[known] * np.int64(max(1, len(hashes))) + at[known], return_counts=True)
            text, term = np.divmod(key, max(1, len(hashes)))
            held = np.bincount(text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), lists(pa.array(term.astype(np.int32)), held),
                 lists(pa.array(tf.astype(np.int32)), held)], names=["id", "n", "terms", "tf"]
            ).filter(pa.array(n > 0))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        read, "id long, n long, terms array<int>, tf array<int>")


def index(docs: DataFrame, hashes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The stratified index (id, m, terms, tf), dealt by ranges of strata, and the weight of each term."""
    rows = written(postings(docs, hashes, id_col, text_col), "search-postings")
    size = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l"), F.sum(F.size("terms")).alias("p")).first()
    weight = np.zeros(len(hashes), np.int64)
    if not size["n"]:
        return rows.select("id", F.col("n").alias("m"), "terms", "tf"), weight
    df = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()  # a row a term
    held = np.zeros(len(hashes))
    held[df.column("t").to_numpy()] = df.column("n").to_numpy()
    weight = np.floor(1000 * np.log((2.0 * size["n"] + 2) / (2 * held + 1))).astype(np.int64)
    m = F.expr(f"25L + ((75L * n * {size['n']}L) div {size['l']}L)")
    parts = parts_for(size["p"], PART, docs.sparkSession.sparkContext.defaultParallelism)
    return rows.select("id", m.alias("m"), "terms", "tf").repartitionByRange(parts, "m", "id"), weight


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    size = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def summed(at: np.ndarray, value: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """Sums of integers by place; ``exact`` where all sums stay below 2 ** 53, so that floats hold them."""
    if exact:
        return np.bincount(at, value, minlength=n).astype(np.int64)
    low, high = value & ((1 << 24) - 1), value >> 24
    return (np.bincount(at, high, minlength=n).astype(np.int64) << 24) + np.bincount(at, low, minlength=n).astype(np.int64)


class Strata:
    """Postings of some documents by (term, stratum, tf), each run with its impact and each stratum with its bounds."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, held: np.ndarray, term: np.ndarray, tf: np.ndarray):
        order = np.lexsort((ids, m))
        self.ids, m = ids[order], m[order]
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        self.start = np.concatenate([first, [len(m)]])  # a stratum's documents
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        doc = np.repeat(back, held)
        stratum = np.searchsorted(first, doc, "right") - 1
        by = np.lexsort((tf, stratum, term))
        self.doc, term, tf, stratum = doc[by], term[by], tf[by].astype(np.int64), stratum[by]
        new_entry = np.concatenate([[True], (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])]) if len(by) else by
        new_run = new_entry | np.concatenate([[True], tf[1:] != tf[:-1]]) if len(by) else by
        run = np.flatnonzero(new_run)
        # once for each (term, stratum, tf)
        impact = 1_000_000_000 * tf[run] // (1000 * tf[run] + 8 * m[first][stratum[run]])
        self.impact = np.repeat(impact, np.diff(np.concatenate([run, [len(by)]])))
        entry = np.flatnonzero(new_entry)  # a term in a stratum
        self.entry = np.concatenate([entry, [len(by)]])
        self.term, self.stratum = term[entry], stratum[entry]
        self.most = self.impact[self.entry[1:] - 1]  # tf ascends, so the last is the greatest

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of the terms, number of the term of each)."""
        a, z = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        return spans(a, z), np.repeat(np.arange(len(terms)), z - a)

    def search(self, terms: np.ndarray, factor: np.ndarray, best: np.ndarray, top: int) -> np.ndarray:
        """``best`` (rows of score, id), merged with the documents here; ``factor``: weight times repeats."""
        some = factor > 0
        terms, factor = terms[some], factor[some]
        exact = int(factor.sum()) * 1_000_000 < 1 << 53
        entry, of = self.entries(terms)
        if len(entry) == 0:
            return best
        n = len(self.start) - 1
        bound = summed(self.stratum[entry], self.most[entry] * factor[of], n, exact)
        by_stratum = np.argsort(self.stratum[entry], kind="stable")
        entry, of = entry[by_stratum], of[by_stratum]
        cut = np.searchsorted(self.stratum[entry], np.arange(n + 1))
        for s in np.argsort(-bound, kind="stable"):
            least = best[-1, 0] if len(best) == top else 1
            if bound[s] < least:
                break
            e, f = entry[cut[s]:cut[s + 1]], factor[of[cut[s]:cut[s + 1]]]
            a, z = self.entry[e], self.entry[e + 1]
            at = spans(a, z)
            base = self.start[s]
            score = summed(self.doc[at] - base, self.impact[at] * np.repeat(f, z - a), int(self.start[s + 1] - base), exact)
            good = np.flatnonzero(score >= least)
            if len(good) > top:  # ids ascend within a stratum: of equal scores the first stay
                good = good[np.argsort(-score[good], kind="stable")[:top]]
            both = np.concatenate([best, np.stack([score[good], self.ids[good + base]], axis=1)])
            best = both[np.lexsort((both[:, 1], -both[:, 0]))[:top]]
        return best


_LAST = np.iinfo(np.int64).max  # stands for a null id


def found(rows: DataFrame, queries: Queries, weight: np.ndarray, id_type: T.DataType, top: int) -> DataFrame:
    """Each task's best ``top`` documents of each query: (query, item, id, score)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((queries, weight))  # a block of queries, bounded by BLOCK_BYTES
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", id_type),
                           T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])

    def pieces(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n >= SLICE:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held and sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def read(batches):
        queries, weight = shared.value
        best = [np.zeros((0, 2), np.int64) for _ in queries.ids]
        for batch in pieces(batches):
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            held = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            strata = Strata(ids, batch.column(1).to_numpy(zero_copy_only=False), held,
                            batch.column(2).flatten().to_numpy(zero_copy_only=False),
                            batch.column(3).flatten().to_numpy(zero_copy_only=False))
            for q, (terms, times) in enumerate(queries.terms):
                best[q] = strata.search(terms, weight[terms] * times, best[q], top)
        size = [len(b) for b in best]
        if sum(size):
            query = np.repeat(np.arange(len(best)), size)
            all_best = np.concatenate(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array([queries.ids[q] for q in query]).cast(item_type),
                 pa.array(all_best[:, 1], mask=all_best[:, 1] == _LAST), pa.array(all_best[:, 0])],
                names=["query", "item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(id_type)
    return rows.mapInArrow(read, schema)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0."""
    kind = items.schema[item_col].dataType
    out = None
    for queries in blocks(items, item_col, item_text, block_bytes):
        rows, weight = index(docs, queries.hashes, id_col, text_col)
        near = found(rows, queries, weight, kind, top)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
        ranked = near.withColumn("rank", place).filter(F.col("rank") <= top).select(
            F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return docs.sparkSession.createDataFrame([], T.StructType([
            T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, T.LongType()),
            T.StructField("score", T.LongType())]))
    return out
