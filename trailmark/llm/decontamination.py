"""Benchmark decontamination with suffix arrays over the training text (operator 1).

Every task cuts its documents into shards of a few megabytes and builds a word
suffix array of each.  All suffixes of the benchmark are then binary-searched in
it, word by word, which gives the longest verbatim match of each test suffix and
every place where it occurs.  A benchmark text is read in blocks of bounded
size; one pass over the documents handles one block, and passes add up.

Defined results
    * a null or empty text, or one without words, has no words and no hits;
    * benchmark rows without words are ignored; repeated rows and ids count once;
      a null item id is matched like any other and listed as the empty string;
    * repeated documents (also of one id) are each judged, one row out per row in;
    * other columns are carried through untouched, whatever their names, except
      those that this operator adds (``OUT``), which replace older ones.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import giving_back, lists, put_aside, slices, text_buffer, written

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20  # of benchmark text held by a task at a time

#: word bytes: 0-9, a-z (A-Z lower-cased) and everything beyond ASCII
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_END = b"\x00"  # stands between documents; no word contains it

OUT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("item_ids", T.ArrayType(T.StringType())),
       ("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                               T.StructField("length", T.LongType())])))]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class TestBlock:
    """The words of a block of benchmark items as one token sequence, with each suffix's window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab = {_END: 0}
        tokens, item, left, names = [], [], [], {}
        for name, text in items:
            ws = words_of(text)
            k = names.setdefault(name, len(names))
            tokens += [self.vocab.setdefault(w, len(self.vocab)) for w in ws] + [0]
            item += [k] * (len(ws) + 1)
            left += range(len(ws), -1, -1)
        self.names = np.array(list(names), dtype=object)
        self.tokens = np.array(tokens, np.int64)
        left = np.array(left, np.int64)
        self.item = np.array(item, np.int64)
        at = np.flatnonzero(left)
        starts = np.concatenate([[-1], np.flatnonzero(self.tokens == 0)[:-1]]) + 1 if len(tokens) else at
        size = np.repeat(left[starts], left[starts] + 1) if len(tokens) else left
        self.at = at  # where a suffix starts
        self.left = left[at]  # its words up to the item's end
        # words that must match for a hit; 0: no window starts here
        self.need = np.where(self.left >= window, window, np.where(self.left == size[at], self.left, 0))
        self.longest = int(self.left.max(initial=0))


def packed(tokens: np.ndarray, n: int, bits: int, per: int) -> np.ndarray:
    """The first ``per`` tokens of each suffix in one number; nothing follows an unknown word or an end."""
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(per):
        t = tokens[i:i + n] * alive
        key = (key << np.uint64(bits)) | t.astype(np.uint64)
        alive &= t != 0
    return key


def suffix_array(tokens: np.ndarray, n: int, bits: int, per: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that start with a known word, sorted by their first ``depth`` words; their packed keys.

    ``tokens`` is padded by zeros.  Words unknown to the benchmark are 0: no test
    suffix matches past one, so suffixes that differ only behind it stay tied.
    Prefix doubling touches only suffixes that are still tied.
    """
    pos = np.flatnonzero(tokens[:n])
    key = packed(tokens, n, bits, per)[pos]
    order = np.argsort(key, kind="stable")
    sa, key = pos[order], key[order]
    if len(sa) == 0:
        return sa, key
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(len(tokens) + 1, np.int64)  # 0: starts with an unknown word or lies behind the end
    first = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
    rank[sa] = first + 1
    known = per
    while known < depth:
        single = head & np.concatenate([head[1:], [True]])
        tied = np.flatnonzero(~single)
        # a suffix whose first `known` words hold a 0 cannot be told apart further
        nxt = sa[tied] + known
        nxt = np.where(nxt < len(tokens), nxt, len(tokens))
        full = tokens[np.minimum(nxt, len(tokens)) - 1] != 0
        if not full.any():
            break
        k2 = rank[sa[tied]] * np.int64(len(tokens) + 2) + rank[nxt] * full
        o = np.argsort(k2, kind="stable")
        k2, sa[tied] = k2[o], sa[tied][o]
        new = np.concatenate([[True], k2[1:] != k2[:-1]])
        if not (new & ~head[tied]).any():  # the order no longer changes with the depth
            break
        head[tied] = new
        first = np.maximum.accumulate(np.where(head, np.arange(len(sa)), 0))
        rank[sa] = first + 1
        known *= 2
    return sa, key


def bound(tokens, sa, lo, hi, depth, want, right: bool):
    """Vectorised binary search in [lo, hi) for ``want`` at ``depth`` words from the suffix start."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) >> 1
        t = tokens[sa[np.minimum(mid, len(sa) - 1)] + depth]
        up = live & ((t <= want) if right else (t < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)
    return lo


def search(tokens: np.ndarray, n: int, test: TestBlock):
    """For each test suffix: its longest match, the range of the places, and the range at its window's length."""
    bits = max(1, int(len(test.vocab)).bit_length())
    per = max(1, min(63 // bits, WINDOW))
    sa, key = suffix_array(tokens, n, bits, per, test.longest)
    pad = np.concatenate([test.tokens, np.zeros(per + 1, np.int64)])
    m = len(test.at)
    length = np.zeros(m, np.int64)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    hit_lo, hit_hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if len(sa) == 0 or m == 0:
        return sa, length, lo, hi * 0, hit_lo, hit_hi
    # jump over the first words: ranges of the packed prefix, where all of it matches
    q = packed(pad, len(test.tokens), bits, per)[test.at]
    a, b = np.searchsorted(key, q, "left"), np.searchsorted(key, q, "right")
    jump = (a < b) & (test.left >= per) & (np.where(test.need > 0, test.need, per) >= per)
    lo[jump], hi[jump], length[jump] = a[jump], b[jump], per
    done = jump & (test.need == per)
    hit_lo[done], hit_hi[done] = lo[done], hi[done]
    live = np.arange(m)
    live = live[length < test.left]
    while len(live):
        d = length[live]
        want = test.tokens[test.at[live] + d]
        nlo = bound(tokens, sa, lo[live], hi[live], d, want, False)
        nhi = bound(tokens, sa, nlo, hi[live], d, want, True)
        ok = nlo < nhi
        live = live[ok]
        lo[live], hi[live] = nlo[ok], nhi[ok]
        length[live] += 1
        at_window = live[length[live] == test.need[live]]
        hit_lo[at_window], hit_hi[at_window] = lo[at_window], hi[at_window]
        live = live[length[live] < test.left[live]]
    return sa, length, lo, hi, hit_lo, hit_hi


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the index of the range of each."""
    size = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def shard_tokens(col: pa.Array, vocab: dict) -> tuple[np.ndarray, int, np.ndarray]:
    """Token ids of a shard padded by zeros, their number, and each document's first token (n + 1 entries)."""
    buf, ends = text_buffer(col)
    raw = buf.tobytes().translate(_LOWER)
    cut = ends.tolist()
    words = b" \x00 ".join([raw[a:z] for a, z in zip(cut, cut[1:])] + [b""]).split()
    n = len(words)
    tokens = np.zeros(n + 64, np.int64)
    tokens[:n] = np.fromiter(map(vocab.get, words, repeat(-1)), np.int64, n)
    stops = np.flatnonzero(tokens[:n] == 0)
    tokens[tokens < 0] = 0
    return tokens, n, np.concatenate([[0], stops + 1])


def _judge(batch: pa.RecordBatch, text_col: str, test: TestBlock, prior: bool) -> pa.RecordBatch:
    col = batch.column(batch.schema.get_field_index(text_col))
    tokens, n, first = shard_tokens(col, test.vocab)
    tokens = np.concatenate([tokens, np.zeros(test.longest, np.int64)])
    docs = len(col)
    sa, _, _, _, lo, hi = search(tokens, n, test)
    edge = np.zeros(n + 1, np.int64)
    # equal windows have equal ranges: mark each range's places once
    uniq = np.unique(np.stack([lo, hi, test.need])[:, hi > lo], axis=1)
    at, which = expand(uniq[0], uniq[1])
    places = sa[at]
    np.add.at(edge, places, 1)
    np.add.at(edge, places + uniq[2][which], -1)
    hit = np.cumsum(edge)[:n] > 0
    n_words = np.diff(first) - 1

    pairs = [np.zeros((2, 0), np.int64)]
    found = np.flatnonzero(hi > lo)
    per_item = np.unique(np.stack([test.item[test.at[found]], lo[found], hi[found]]), axis=1)
    step = max(1, (4 << 20) // max(1, int((per_item[2] - per_item[1]).max(initial=1))))
    for i in range(0, per_item.shape[1], step):  # in steps of bounded size
        at, which = expand(per_item[1, i:i + step], per_item[2, i:i + step])
        doc = np.searchsorted(first, sa[at], "right") - 1
        pairs.append(np.unique(np.stack([doc, per_item[0, i:i + step][which]]), axis=1))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    names = [[] for _ in range(docs)]
    for d, k in zip(pairs[0].tolist(), pairs[1].tolist()):
        names[d].append(test.names[k])
    old = {name: batch.column(batch.schema.get_field_index(name)) for name, _ in OUT} if prior else None
    if prior:
        for d, (items, spans) in enumerate(zip(old["item_ids"].to_pylist(), old["hit_spans"].to_pylist())):
            names[d] = sorted({*names[d], *items})
            for s in spans:
                hit[first[d] + s["start"]:first[d] + s["start"] + s["length"]] = True
    else:
        names = [sorted(x) for x in names]
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:] - 1] - total[first[:-1]]
    h = np.concatenate([[False], hit, [False]])
    start = np.flatnonzero(h[1:] & ~h[:-1])
    stop = np.flatnonzero(~h[1:] & h[:-1])
    doc = np.searchsorted(first, start, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(stop - start)], ["start", "length"])
    new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
           "item_ids": pa.array(names, pa.list_(pa.string())),
           "hit_spans": lists(spans, np.bincount(doc, minlength=docs))}
    cols = [c for c in batch.schema.names if c not in new]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(c)) for c in cols] + [new[c] for c, _ in OUT],
        names=cols + [c for c, _ in OUT])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark's rows in blocks of bounded size (a driver holds one block at a time)."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                            F.col(text_col).cast("string").alias("t")).filter("t is not null")
    for r in rows.toLocalIterator():
        text = r["t"].encode("utf-8", "surrogatepass")
        block.append((r["i"], text))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` and ``hit_spans`` (runs of hit words).

    A word is hit if it lies in an occurrence of ``window`` consecutive words of
    an item (or of a whole shorter item).  No shuffle: each task searches the
    block's suffixes in its own shards.  Each further block of ``block_bytes``
    is another pass, whose hits are added to those before.
    """
    spark = docs.sparkSession
    out = docs.drop(*[c for c, _ in OUT])
    base = out.columns
    schema = T.StructType([*out.schema.fields, *[T.StructField(c, t) for c, t in OUT]])
    passes = 0
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if passes:
            out = written(out, "decontamination")
        shared = spark.sparkContext.broadcast(items)  # at most block_bytes and one item

        def judge(batches, shared=shared, prior=bool(passes)):
            test = TestBlock(shared.value, window)
            for batch in slices(batches, text_col, SHARD_BYTES):
                yield _judge(batch, text_col, test, prior)

        out = out.mapInArrow(giving_back(judge), schema)
        passes += 1
    if not passes:  # an empty benchmark hits nothing
        def count(batches):
            test = TestBlock([], window)
            for batch in slices(batches, text_col, SHARD_BYTES):
                yield _judge(batch, text_col, test, False)

        out = out.mapInArrow(count, schema)
    return out.select(*base, *[c for c, _ in OUT])


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", least: int = 2) -> DataFrame:
    """Longest verbatim match of each test suffix over all shards: length and one place.

    One row per (item, word position) with a match of ``least`` words or more;
    of equally long ones the place with the smallest id and position.  Shards
    emit one row per suffix, so the reduce is by (item, position) with
    map-side combine.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("item_pos", T.LongType()),
                           T.StructField("n_words", T.LongType()), T.StructField("doc", kind),
                           T.StructField("doc_pos", T.LongType())])
    parts = []
    for items in _blocks(benchmark, item_col, item_text_col, BLOCK_BYTES):
        shared = spark.sparkContext.broadcast(items)

        def best(batches, shared=shared):
            test = TestBlock(shared.value, WINDOW)
            start = {}
            for at, item in zip(test.at.tolist(), test.item[test.at].tolist()):
                start.setdefault(item, at)
            for batch in slices(batches, text_col, SHARD_BYTES):
                col = batch.column(batch.schema.get_field_index(text_col))
                tokens, n, first = shard_tokens(col, test.vocab)
                tokens = np.concatenate([tokens, np.zeros(test.longest, np.int64)])
                sa, length, lo, hi, _, _ = search(tokens, n, test)
                k = np.flatnonzero(length >= least)
                place = np.array([sa[a:z].min() for a, z in zip(lo[k], hi[k])], np.int64)
                doc = np.searchsorted(first, place, "right") - 1
                item = test.item[test.at[k]]
                pos = test.at[k] - np.array([start[i] for i in item.tolist()], np.int64)
                ids = batch.column(batch.schema.get_field_index(id_col))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(test.names[item].tolist(), pa.string()), pa.array(pos, pa.int64()),
                     pa.array(length[k], pa.int64()), ids.take(pa.array(doc)),
                     pa.array(place - first[doc], pa.int64())], names=[f.name for f in schema.fields])

        parts.append(docs.select(id_col, text_col).mapInArrow(best, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pick = F.min(F.struct((-F.col("n_words")).alias("less"), "doc", "doc_pos")).alias("b")
    return (out.groupBy("item", "item_pos").agg(pick)
            .select(F.col("item").alias("item_id"), "item_pos", (-F.col("b.less")).alias("n_words"),
                    F.col("b.doc").alias("doc_id"), F.col("b.doc_pos").alias("doc_pos")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, same columns.

    Null and empty texts stay, repeated rows go or stay together, an empty benchmark removes nothing, and columns of
    the names that ``contamination`` adds keep their own values.
    """
    plain, back = put_aside(docs, [c for c, _ in OUT])
    return back(contamination(plain, benchmark, text_col).filter("n_hit = 0"))
