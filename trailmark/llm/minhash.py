"""Near-duplicates by b-bit MinHash (operator 3).

A document is its set of word shingles.  Each set gets 128 minima; groups of four
are band keys, and two bits of each minimum, packed into four numbers, are its
signature.  Sets that share a band key are candidates; the share of equal bits,
corrected for chance collisions, estimates their similarity, and those that may
reach the threshold are confirmed on the full sets.

Equal word sequences are one class from the start.  No step forms all pairs of a
group in rows.  Inside a band key the classes are searched breadth-first by their
signatures: each found class is compared with those not found yet, so a key of
mutual copies costs one comparison a class, and only its tree leaves the task.
Trees of all keys make clusters; two classes that are linked are always in one.
In a cluster every class is first confirmed against its smallest one.  Clusters
with classes left over are searched in full, exactly, block against block in
separate tasks; again only a spanning tree of confirmed links leaves a task.
Nothing is capped.

The chance that a pair at similarity 0.8 shares no band key is
(1 - 0.8**4)**32 < 1e-7; the estimate's cut lies six deviations below it.

Defined results: null or empty texts, and texts without words, have no shingles
and are linked with nothing; a text of fewer words than a shingle is one shingle;
rows that share an id are one node; a null id is never linked and has no
component; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import giving_back, lists, mixed, slices, text_buffer, word_hashes, written
from trailmark.llm.graph import components

HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
WORDS_OF_SIG = HASHES * BITS // 64
CHUNK = 4 << 20
KEY_BLOCK = 4096  # classes of a band key searched by one task: two blocks at most
SET_BLOCK = 512  # full sets of a cluster compared by one task: two blocks at most
SLACK = 6  # deviations of the estimate below the threshold at which a candidate is given up
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2 ** 64, HASHES, dtype=np.uint64)
#: white space of the words: space and 0x09-0x0D; A-Z lower-cased
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def sequences(col: pa.Array, width: int):
    """Word hashes of all texts, hash of the shingle that starts at each word, first word of each text (n + 1),
    and where each word starts and stops in the texts' bytes."""
    buf, ends = text_buffer(col)
    buf = _LOWER[buf]
    space = _SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[ends] = True
    begin = ~space & (np.concatenate([[True], space[:-1]]) | edge[:-1]) if len(buf) else space
    finish = ~space & (np.concatenate([space[1:], [True]]) | edge[1:]) if len(buf) else space
    start, stop = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    h = word_hashes(buf, start, stop)
    rolled = np.zeros(len(h), np.uint64)
    place = 1
    for j in range(min(width, len(h))):
        place = (place * 0xD1342543DE82EF95 + 2 * j + 1) % 2 ** 64
        rolled[:len(h) - j] += mixed(h[j:] + np.uint64(place))
    return h, mixed(rolled), np.searchsorted(start, ends), start, stop


def shingles(col: pa.Array, width: int) -> list[tuple[np.ndarray, bytes]]:
    """(sorted 64-bit codes of the distinct shingles, digest of the word sequence) of each text."""
    h, rolled, cut, _, _ = sequences(col, width)
    out = []
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        n = z - a
        if n >= width:
            codes = np.unique(rolled[a:z - width + 1])
        elif n:
            codes = np.frombuffer(hashlib.blake2b(h[a:z].tobytes(), digest_size=8).digest(), np.uint64)
        else:
            codes = h[:0]
        out.append((codes, hashlib.blake2b(h[a:z].tobytes(), digest_size=16).digest()))
    return out


def minima(codes: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2 ** 32 - 1, np.uint32)
    for i in range(0, len(codes), 2048):
        v = ((codes[i:i + 2048, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, v.min(axis=0))
    return low


def bands(low: np.ndarray) -> np.ndarray:
    rows = low.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + rows[:, i])
    return key.view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed."""
    per = 64 // BITS
    bits = (low & np.uint32(2 ** BITS - 1)).astype(np.uint64).reshape(WORDS_OF_SIG, per)
    return (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig, bands) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>")

    def read(batches):
        for batch in slices(batches, "text", CHUNK):
            found = shingles(batch.column(1), width)
            some = np.array([len(c) > 0 for c, _ in found])
            low = [minima(c) for c, _ in found if len(c)]
            keys = np.frombuffer(b"".join(d for _, d in found), np.int64).reshape(-1, 2)
            sig = np.concatenate([signature(x) for x in low]) if low else np.zeros(0, np.int64)
            band = np.concatenate([bands(x) for x in low]) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(c) for c, _ in found], pa.int64()), pa.array(keys[:, 0]),
                 pa.array(keys[:, 1]), lists(pa.array(sig), some * WORDS_OF_SIG), lists(pa.array(band), some * BANDS)],
                names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        giving_back(read), schema)


def cut_for(threshold: float) -> float:
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * threshold
    return threshold - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, cluster, codes) of the classes in ``wanted`` (cid, cluster, doc_id, k1, k2), read from their documents."""

    def read(batches):
        for batch in slices(batches, "text", CHUNK):
            found = shingles(batch.column(4), width)
            keys = np.frombuffer(b"".join(d for _, d in found), np.int64).reshape(-1, 2)
            own = (keys[:, 0] == batch.column(2).to_numpy()) & (keys[:, 1] == batch.column(3).to_numpy())
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
                 pa.array([found[i][0].tobytes() for i in at], pa.binary())], names=["cid", "cluster", "codes"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = wanted.join(texts, "doc_id").select("cid", "cluster", "k1", "k2", "text")
    return rows.mapInArrow(giving_back(read), "cid long, cluster long, codes binary")


def runs(batches, names: list[str]):
    """Rows of sorted batches gathered by their first columns ``names``: (key, rows) of each run."""
    held, last, k = [], None, len(names)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols):
            if row[:k] != last:
                if held:
                    yield last, held
                held, last = [], row[:k]
            held.append(row[k:])
    if held:
        yield last, held


def in_blocks(df: DataFrame, key: str, size: int, cols: list[str]) -> DataFrame:
    """Rows of ``key`` (of ``n`` rows) dealt to pairs of blocks (i, j), so that any two rows meet in one of them."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    dealt = df.withColumn("own", F.pmod(F.xxhash64("cid", key), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *cols)
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "cid")


def edges_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                       pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def trees(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which ``near(i, some)`` tells which of ``some`` are i's neighbours."""
    out, left = [], np.arange(n)
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit].tolist()
            out += [(i, j) for j in found]
            queue += found
            left = left[~hit]
    return out


def likely(shared: DataFrame, cut: float) -> DataFrame:
    """Edges (a, b) of a spanning forest, for each band key, of the pairs estimated at ``cut`` or more.

    ``shared`` has key, cid, sig and n, the key's classes.
    """

    def scan(batches):
        mask, chance = np.uint64(0x5555555555555555), 2.0 ** -BITS
        most = int((1 - cut) * (1 - chance) * HASHES)
        for _, rows in runs(batches, ["key", "i", "j"]):
            if len(rows) < 2:
                continue
            cid = [r[0] for r in rows]
            sig = np.array([r[1] for r in rows], np.int64).view(np.uint64)

            def near(i, some):
                x = sig[some] ^ sig[i]
                return np.bitwise_count((x | (x >> np.uint64(1))) & mask).sum(axis=1, dtype=np.int64) <= most

            if pairs := trees(len(rows), near):
                yield edges_batch([(cid[i], cid[j]) for i, j in pairs])

    return in_blocks(shared, "key", KEY_BLOCK, ["cid", "sig"]).mapInArrow(giving_back(scan), "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have den * intersection >= num * union."""
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    both = np.sort(np.concatenate([x, y]))  # what equals its neighbour is common
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(x) + len(y) - common)


def starred(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, cluster, linked): whether each class is linked to its cluster's smallest one."""
    hubs = sets.filter("cid = cluster").select("cluster", F.col("codes").alias("hub"))

    def check(batches):
        for batch in batches:
            linked = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den)
                      for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                             names=["cid", "cluster", "linked"])

    return sets.join(hubs, "cluster").select("cid", "cluster", "codes", "hub").mapInArrow(
        giving_back(check), "cid long, cluster long, linked boolean")


def intersections(codes: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by matrix products over the codes that repeat."""
    n = len(codes)
    owner = np.repeat(np.arange(n), [len(c) for c in codes])
    flat = np.concatenate(codes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.concatenate([[True], flat[1:] != flat[:-1]])
    which = np.cumsum(head) - 1
    often = np.bincount(which) > 1
    keep = often[which]
    owner, which = owner[keep], (np.cumsum(often) - 1)[which[keep]]
    out = np.zeros((n, n), np.float32)
    step = 1024
    cut = np.searchsorted(which, np.arange(0, int(often.sum()) + step, step))
    for k, (a, z) in enumerate(zip(cut, cut[1:])):
        dense = np.zeros((n, step), np.float32)
        dense[owner[a:z], which[a:z] - k * step] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def remaining(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of a spanning forest, for each two blocks of a cluster, of all pairs that are linked.

    ``members`` has cluster, cid, comp (what the star has joined), codes and n.
    """

    def scan(batches):
        for _, rows in runs(batches, ["cluster", "i", "j"]):
            comp = np.array([r[1] for r in rows], np.int64)
            if (comp == comp[0]).all():
                continue
            codes = [np.frombuffer(r[2], np.uint64) for r in rows]
            size = np.array([len(c) for c in codes], np.int64)
            common = intersections(codes)
            true = den * common >= num * (size[:, None] + size[None, :] - common)
            known = comp[:, None] == comp[None, :]
            near = true | known
            pairs = [(i, j) for i, j in trees(len(rows), lambda i, some: near[i, some]) if not known[i, j]]
            if pairs:
                yield edges_batch([(rows[i][0], rows[j][0]) for i, j in pairs])

    return in_blocks(members, "cluster", SET_BLOCK, ["cid", "comp", "codes"]).mapInArrow(giving_back(scan), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the smallest id reachable over links (den * intersection
    >= num * union of the shingle sets), the document's own included.
    """
    table = written(signed(docs, width, id_col, text_col), "minhash")
    known = table.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = written(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"),
                                                    F.first("bands").alias("bands"))
                      .withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")

    post = classes.select("cid", F.explode("bands").alias("key"))
    keys = post.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = post.join(keys, "key").join(classes.select("cid", "sig"), "cid")
    clusters = written(components(likely(shared, cut_for(num / den))), "minhash-clusters").withColumnsRenamed(
        {"node": "cid", "comp": "cluster"})

    wanted = classes.join(clusters, "cid").select("cid", "cluster", "doc_id", "k1", "k2")
    sets = written(sets_of(docs, wanted, width, id_col, text_col).dropDuplicates(["cid"]), "minhash-sets")
    star = written(starred(sets, num, den), "minhash-stars")
    left = star.groupBy("cluster").agg(F.count("*").alias("n"), F.min("linked").alias("all")).filter(~F.col("all"))
    comp = F.when(F.col("linked"), F.col("cluster")).otherwise(F.col("cid")).alias("comp")
    members = star.join(left.select("cluster", "n"), "cluster").select("cid", "n", comp).join(sets, "cid")
    links = star.filter("linked AND cid != cluster").select(F.col("cid").alias("a"), F.col("cluster").alias("b"))
    links = links.unionByName(remaining(members, num, den))

    # rows of one id are one node: their classes are linked
    of = known.join(classes.select("k1", "k2", "cid"), ["k1", "k2"]).select(F.col("doc_id").alias("d"), "cid")
    several = of.groupBy("d").agg(F.min("cid").alias("b"), F.max("cid").alias("top")).filter("b != top")
    same_id = of.join(several, "d").filter("cid != b").select(F.col("cid").alias("a"), "b").distinct()

    comp = written(components(links.unionByName(same_id)), "minhash-components")
    named = comp.join(classes.select(F.col("cid").alias("node"), "doc_id"), "node")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component"))
    of_class = (classes.select("cid", "k1", "k2", "doc_id")
                .join(comp.join(least, "comp").select(F.col("node").alias("cid"), "component"), "cid", "left")
                .select("k1", "k2", F.coalesce("component", "doc_id").alias("component")))
    found = table.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    some = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    own = found.select("doc_id", "n_shingles", F.when(some, F.coalesce("component", "doc_id")).otherwise(
        F.col("doc_id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def clean(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group (the smallest id), same columns.

    Null and empty texts and rows of a null id stay; rows that share an id go or stay together.
    """
    found = near_duplicates(docs, width, num, den, id_col, text_col)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
