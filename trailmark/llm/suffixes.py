"""Exact substring de-duplication with suffix arrays built by two-stage sorting (operator 4).

A byte is removed if a 50-byte string that covers it also starts in a document
with a smaller id.  Suffix arrays of the whole corpus would have to be merged
across all tasks; instead every 50-byte window is sent to the task that holds all
windows with the same content key (the least hash of its 20-byte substrings), so
equal windows always meet:

1. Documents are gathered into chunks of about two megabytes, compressed, written.
2. Each chunk lists its keys; a key seen in one document only cannot repeat.
3. For the other keys, maximal runs of windows with one key (segments of some 65
   bytes) go to the key's task, each different segment once a chunk with its
   smallest document: however often a passage occurs, a chunk sends it once.
4. Each task joins its segments to one text and sorts its suffixes in two stages:
   only suffixes smaller than their successors are sorted directly, the others are
   induced by scanning the buckets of first bytes.  Adjacent common prefixes of 50
   bytes or more make groups of equal windows, whose smallest document goes back.
5. Each chunk marks the windows that occur in a smaller document, and cuts.

Defined results: null texts are empty; texts shorter than 50 bytes keep all;
rows that share an id (also null, which comes first) are one place in the order
and never remove from each other; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import (lists, mixed, parts_for, powers, prefix_hash, release, slices, text_buffer, text_bytes,
                                  written)

LENGTH = 50
KMER = 20
CHUNK_BYTES = 2 << 20
PART_KEYS = 1 << 20
PART_BYTES = 3 << 20  # of segments in one suffix array
SEGMENTS_PER_BYTE = 1.2  # expected segment bytes for each byte of text
_LOW = np.uint64((1 << 40) - 1)
_NULL_ID = -(2 ** 63)


# --- two-stage suffix sorting ------------------------------------------------------------------

def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (the last is not: the end is smallest)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    # equal bytes decide as the next unequal pair does
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return step[nxt] > 0


def eights(text: np.ndarray, reach: int) -> np.ndarray:
    """Eight bytes from each place on as one number; zeros behind the end."""
    n = len(text) + reach
    padded = np.zeros(n + 8, np.uint8)
    padded[:len(text)] = text
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i:i + n]
    return key


def sort_directly(key: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Places ``pos`` sorted by the ``depth`` bytes that follow, eight at a time, ties only."""
    levels = -(-depth // 8)
    order = np.argsort(key[pos], kind="stable")
    sa = pos[order]
    k = key[sa]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    for level in range(1, levels):
        single = head & np.concatenate([head[1:], [True]])
        tied = np.flatnonzero(~single)
        if len(tied) == 0:
            break
        group = np.cumsum(head[tied])
        # groups whose members agree in all that is left need no sorting
        same = np.ones(len(tied), bool)
        for later in range(level, levels):
            k = key[sa[tied] + 8 * later]
            same[1:] &= k[1:] == k[:-1]
        odd = ~same & ~head[tied]
        bad = np.unique(group[odd])
        if len(bad) == 0:
            break
        tied = tied[np.isin(group, bad)]
        k = key[sa[tied] + 8 * level]
        g = np.cumsum(head[tied])
        o = np.lexsort((k, g))
        sa[tied] = sa[tied][o]
        k, g = k[o], g[o]
        head[tied] = np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])])
    return sa


def suffix_array(text: np.ndarray, depth: int, key: np.ndarray | None = None) -> np.ndarray:
    """All suffixes sorted by at least their first ``depth`` bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    key = eights(text, depth + 8) if key is None else key
    small = smaller_than_next(text)
    direct = sort_directly(key, np.flatnonzero(small).astype(np.int32), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1], np.int32))
    out = []

    def induce(batch: np.ndarray, bucket: int) -> np.ndarray:
        """Sends the greater predecessors of a scanned run to their buckets; returns those of this one."""
        p = batch[batch > 0] - 1
        p = p[~small[p]]
        if len(p) == 0:
            return p
        first = text[p]
        o = np.argsort(first, kind="stable")
        p, first = p[o], first[o]
        cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])).tolist() + [len(p)]
        here = p[:0]
        for a, z in zip(cut, cut[1:]):
            if first[a] == bucket:
                here = p[a:z]
            else:
                waiting[first[a]].append(p[a:z])
        return here

    for c in range(256):
        runs, waiting[c] = waiting[c], []
        run = np.concatenate(runs) if runs else direct[:0]
        while len(run):  # runs of one byte induce in their own bucket
            out.append(run)
            run = induce(run, c)
        run = direct[bounds[c]:bounds[c + 1]]
        if len(run):
            out.append(run)
            induce(run, c)
    return np.concatenate(out)


def equal_next(key: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has a common prefix of ``length`` bytes or more with the one before it in order."""
    same = np.ones(len(sa), bool)
    same[:1] = False
    for at in [*range(0, length - 8, 8), length - 8]:
        k = key[sa + at]
        same[1:] &= k[1:] == k[:-1]
    return same


# --- windows, keys and segments of a chunk -----------------------------------------------------

class Chunk:
    """A chunk's texts one after the other, and its runs of windows with one key."""

    def __init__(self, ids, ends, blob: bytes, length: int):
        self.length = length
        self.ids = np.array([_NULL_ID if i is None else i for i in ids], np.int64)
        self.ends = np.asarray(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        n = len(self.buf) - length + 1
        if n <= 0:
            self.run_start = self.run_stop = np.zeros(0, np.int64)
            self.run_key, self.run_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        least = window_keys(self.buf, length)
        change = np.concatenate([[True], least[1:] != least[:-1]])
        # windows that would cross the end of a document are none
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.clip(self.ends - length + 1, self.starts, n), 1)
        np.add.at(edge, np.minimum(self.ends, n), -1)
        crossing = np.cumsum(edge)[:n] > 0
        change |= np.concatenate([[False], crossing[1:] != crossing[:-1]])
        inside = self.starts[self.starts < n]
        change[inside] = True
        start = np.flatnonzero(change)
        stop = np.concatenate([start[1:], [n]])
        keep = ~crossing[start]
        self.run_start, self.run_stop = start[keep], stop[keep]
        self.run_key = least[self.run_start]
        self.run_doc = np.searchsorted(self.ends, self.run_start, "right")

    def places(self) -> np.ndarray:
        return self.ids[self.run_doc]

    def shared(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the runs whose key is among ``keys`` (sorted)."""
        if len(keys) == 0:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, self.run_key), len(keys) - 1)
        return np.flatnonzero(keys[at] == self.run_key)

    def segments(self, runs: np.ndarray):
        """(first run of each different segment, index of the segment of each run), in order of first sight."""
        data, seen = self.buf.tobytes(), {}
        tail = self.length - 1
        which = np.fromiter(
            (seen.setdefault(data[a:z + tail], len(seen))
             for a, z in zip(self.run_start[runs].tolist(), self.run_stop[runs].tolist())), np.int64, len(runs))
        first = np.zeros(len(seen), np.int64)
        first[which[::-1]] = np.arange(len(runs))[::-1]
        return list(seen), first, which


def window_keys(buf: np.ndarray, length: int, kmer: int = KMER) -> np.ndarray:
    """Least hash of the ``kmer``-byte substrings of each window of ``length`` bytes."""
    sums = prefix_hash(buf)
    _, down = powers(len(buf) + 1)
    h = mixed((sums[kmer:] - sums[:-kmer]) * down[:len(buf) - kmer + 1])
    del sums
    width, span = length - kmer + 1, 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


# --- the distributed steps ---------------------------------------------------------------------

def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, ends, blob): documents gathered as they are read; written, so that chunks stay what they are."""

    def gather(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        ids, ends, parts, size = [], [], [], 0

        def row():
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([ends], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["chunk", "ids", "ends", "blob"])

        for batch in slices(batches, "text", chunk_bytes // 8):
            buf, cut = text_buffer(batch.column(1))
            ids += batch.column(0).to_pylist()
            ends += (cut[1:] + size).tolist()
            parts.append(buf.tobytes())
            size += len(buf)
            if size >= chunk_bytes:
                yield row()
                k += 1
                ids, ends, parts, size = [], [], [], 0
        if ids:
            yield row()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(base.mapInArrow(gather, "chunk long, ids array<long>, ends array<long>, blob binary"), "chunks")


def read_chunks(batch: pa.RecordBatch, length: int):
    for chunk, ids, ends, blob in zip(*[batch.column(i) for i in range(4)]):
        yield chunk.as_py(), Chunk(ids.as_py(), ends.as_py(), blob.as_py(), length)


def by_part(part: np.ndarray, parts: int):
    """(part, indices) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), order[cut[p]:cut[p + 1]]


def repeated_keys(chunks: DataFrame, parts: int, length: int) -> DataFrame:
    """(chunk, blob): the keys of each chunk that occur in two documents or more."""

    def keys(batches):
        for batch in batches:
            for chunk, c in read_chunks(batch, length):
                order = np.lexsort((c.places(), c.run_key))
                key, place = c.run_key[order], c.places()[order]
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
                if len(head) == 0:
                    continue
                several = np.minimum.reduceat(place, head) != np.maximum.reduceat(place, head)
                key = key[head]
                out = []
                for p, at in by_part(part_of(key, parts), parts):
                    k = key[at] & _LOW
                    five = k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].ravel()
                    out.append((p, five.tobytes(), np.packbits(several[at]).tobytes()))
                ps, blobs, flags = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ps, pa.int64()), pa.array([chunk] * len(ps), pa.int64()), pa.array(blobs, pa.binary()),
                     pa.array(flags, pa.binary())], names=["part", "chunk", "keys", "flags"])

    def common(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk").to_numpy()
        raw = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in group.column("keys").to_pylist()]
        sizes = np.array([len(x) for x in raw])
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :5] = np.concatenate(raw)
        key = wide.view("<u8").ravel()
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for f, n in zip(
            group.column("flags").to_pylist(), sizes.tolist())])
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        good = several[order].copy()
        good[1:] |= same
        good[:-1] |= same
        # a key that is one chunk's alone stays only if several documents of the chunk have it
        hit = np.zeros(len(key), bool)
        hit[order] = good
        at = np.concatenate([[0], np.cumsum(sizes)])
        part = group.column("part")[0].as_py()
        keep = [(c, wide[a:z][hit[a:z], :5].tobytes()) for c, a, z in zip(chunk.tolist(), at, at[1:]) if hit[a:z].any()]
        return pa.table([pa.array([x[0] for x in keep], pa.int64()), pa.array([part] * len(keep), pa.int64()),
                         pa.array([x[1] for x in keep], pa.binary())], names=["chunk", "part", "blob"])

    listed = chunks.mapInArrow(keys, "part long, chunk long, keys binary, flags binary")
    return written(listed.groupBy("part").applyInArrow(common, "chunk long, part long, blob binary"), "chunk-keys")


def shared_keys(c: Chunk, rows: list[tuple[int, bytes]], parts: int) -> np.ndarray:
    """The chunk's own keys named by (part, low 40 bits), sorted."""
    mine = np.unique(c.run_key)
    name = (part_of(mine, parts).astype(np.uint64) << np.uint64(40)) | (mine & _LOW)
    got = [np.zeros(0, np.uint64)]
    for part, blob in rows:
        wide = np.zeros((len(blob) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
        got.append((np.uint64(part) << np.uint64(40)) | wide.view("<u8").ravel())
    return mine[np.isin(name, np.concatenate(got))]


def one_chunk(left: pa.Table, length: int):
    for batch in left.combine_chunks().to_batches():
        for chunk, c in read_chunks(batch.select(["chunk", "ids", "ends", "blob"]), length):
            return chunk, c


def sent(c: Chunk, keys: np.ndarray, parts: int):
    """The chunk's different segments with a shared key: bytes, smallest place, part, and what each run has."""
    runs = c.shared(keys)
    # runs in order of place: a segment's first sight is in its smallest document
    runs = runs[np.argsort(c.places()[runs], kind="stable")]
    text, first, which = c.segments(runs)
    place = c.places()[runs[first]] if len(first) else np.zeros(0, np.int64)
    part = part_of(c.run_key[runs[first]], parts) if len(first) else np.zeros(0, np.int64)
    last = np.full(len(first), _NULL_ID)
    np.maximum.at(last, which, c.places()[runs])
    return runs, text, which, place, last, part


def smallest_places(chunks: DataFrame, keys: DataFrame, key_parts: int, parts: int, length: int) -> DataFrame:
    """(chunk, part, blob): for the chunk's segments of a part, runs of windows and their smallest document."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["part", "chunk", "blob"]
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=names)
        chunk, c = one_chunk(left, length)
        rows = list(zip(right.column("part").to_pylist(), right.column("blob").to_pylist()))
        _, text, _, place, last, part = sent(c, shared_keys(c, rows, key_parts), parts)
        out = []
        for p, at in by_part(part, parts):
            data = b"".join([text[i] for i in at.tolist()])
            size = np.array([len(text[i]) for i in at.tolist()], "<i4")
            out.append((p, pack(size, place[at], (last[at] != place[at]).astype(np.uint8), np.frombuffer(data, np.uint8))))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()),
                         pa.array([x[1] for x in out], pa.binary())], names=names)

    def match(group: pa.Table) -> pa.Table:
        return matched_part(group, length)

    sent_rows = chunks.groupBy("chunk").cogroup(keys.groupBy("chunk")).applyInArrow(
        send, "part long, chunk long, blob binary")
    return written(sent_rows.groupBy("part").applyInArrow(match, "chunk long, part long, blob binary"), "chunk-places")


def matched_part(group: pa.Table, length: int) -> pa.Table:
    """All segments of a part against each other."""
    part = group.column("part")[0].as_py()
    seen: dict[bytes, int] = {}
    least: list[int] = []
    sources = []
    for chunk, blob in zip(group.column("chunk").to_pylist(), group.column("blob").to_pylist()):
        size, place, several, data = unpack(blob, "<i4", "<i8", np.uint8, np.uint8)
        raw, cut = data.tobytes(), np.concatenate([[0], np.cumsum(size)]).tolist()
        which = np.fromiter((seen.setdefault(raw[a:z], len(seen)) for a, z in zip(cut, cut[1:])), np.int64, len(size))
        sources.append((chunk, which, place, several))
    lowest = np.full(len(seen), 2 ** 63 - 1, np.int64)
    for _, which, place, _ in sources:
        np.minimum.at(lowest, which, place)
    segments = list(seen)
    del seen
    size = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"".join(segments), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)])
    key = eights(text, length + 16)
    sa = suffix_array(text, length, key)
    # places where a whole window starts
    n = len(text)
    edge = np.zeros(n + 1, np.int8)
    edge[start[:-1]] = 1
    np.add.at(edge, start[1:] - length + 1, -1)
    valid = np.cumsum(edge[:n]) > 0
    sa = sa[valid[sa]]
    owner = np.zeros(n, np.int32)
    owner[start[1:-1]] = 1
    owner = np.cumsum(owner)
    head = np.flatnonzero(~equal_next(key, sa, length))
    groups = np.minimum.reduceat(lowest[owner[sa]], head) if len(sa) else lowest[:0]
    smallest = np.empty(n, np.int64)
    smallest[sa] = np.repeat(groups, np.diff(np.concatenate([head, [len(sa)]])))
    # per segment: runs of windows with one smallest place
    at = np.flatnonzero(valid)
    value, seg = smallest[at], owner[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])])
    run = np.flatnonzero(new)
    run_len = np.diff(np.concatenate([run, [len(at)]])).astype("<i4")
    run_value, run_seg = value[run], seg[run]
    first_run = np.searchsorted(run_seg, np.arange(len(segments) + 1))
    rows = []
    for chunk, which, place, several in sources:
        n_runs = (first_run[which + 1] - first_run[which]).astype(np.int64)
        # nothing to say where the segment is one document's and no window is in a smaller one
        plain = (n_runs == 1) & (several == 0) & (run_value[first_run[which]] == place)
        say = np.flatnonzero(~plain)
        if len(say) == 0:
            continue
        w = which[say]
        counts = n_runs[say]
        idx = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_run[w], counts)
        rows.append((chunk, pack(say.astype("<i4"), counts.astype("<i4"), run_len[idx], run_value[idx])))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()),
                     pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "part", "blob"])


def covered(c: Chunk, keys: np.ndarray, replies: list[tuple[int, bytes]], parts: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    runs, _, which, _, _, part = sent(c, keys, parts)
    n_seg = len(part)
    slot = dict(by_part(part, parts))
    count, first = np.zeros(n_seg, np.int64), np.zeros(n_seg, np.int64)
    lens, values, total = [], [], 0
    for p, blob in replies:
        say, counts, run_len, value = unpack(blob, "<i4", "<i4", "<i4", "<i8")
        seg = slot[p][say]
        count[seg] = counts
        first[seg] = total + np.cumsum(counts) - counts
        total += len(run_len)
        lens.append(run_len.astype(np.int64))
        values.append(value)
    edge = np.zeros(len(c.buf) + 1, np.int64)
    if total:
        run_len, value = np.concatenate(lens), np.concatenate(values)
        # offset of each run inside its segment
        before = np.cumsum(run_len) - run_len
        counts = count[which]
        occ = np.repeat(np.arange(len(which)), counts)
        idx = np.arange(len(occ)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which][occ]
        offset = before[idx] - before[first[which][occ]]
        gone = value[idx] < c.places()[runs][occ]
        begin = c.run_start[runs][occ][gone] + offset[gone]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + run_len[idx][gone] - 1 + c.length, -1)
    return np.cumsum(edge)[:-1] > 0


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            chunk_bytes: int = CHUNK_BYTES, key_parts: int | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: removed runs (start, length) and the remaining bytes."""
    n = text_bytes(docs, text_col)
    key_parts = key_parts or parts_for(n // 14, PART_KEYS)
    parts = parts or parts_for(int(n * SEGMENTS_PER_BYTE), PART_BYTES)
    chunks = chunked(docs, id_col, text_col, chunk_bytes)
    keys = repeated_keys(chunks, key_parts, length)
    places = smallest_places(chunks, keys, key_parts, parts, length)
    release(docs.sparkSession)  # the segments' shuffle files go before the chunks are dealt out again
    replies = keys.withColumn("kind", F.lit(0)).unionByName(places.withColumn("kind", F.lit(1)))
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    names = ["doc_id", "n_bytes", "spans", "kept"]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(span)),
                             pa.array([], pa.binary())], names=names)
        _, c = one_chunk(left, length)
        rows = list(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(),
                        right.column("blob").to_pylist()))
        mine = shared_keys(c, [(p, b) for k, p, b in rows if k == 0], key_parts)
        gone = covered(c, mine, [(p, b) for k, p, b in rows if k == 1], parts)
        # a run ends at the end of its document
        step = np.concatenate([[False], gone, [False]])
        begin = gone & ~step[:-2]
        finish = gone & ~step[2:]
        inner = c.starts[(c.starts > 0) & (c.starts < len(gone))]
        begin[inner] |= gone[inner]
        finish[inner - 1] |= gone[inner - 1]
        a, z = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        doc = np.searchsorted(c.ends, a, "right")
        kept = [c.buf[s:e][~gone[s:e]].tobytes() for s, e in zip(c.starts.tolist(), c.ends.tolist())]
        ids = left.column("ids").to_pylist()[0]
        spans = pa.StructArray.from_arrays([pa.array(a - c.starts[doc], pa.int64()), pa.array(z - a, pa.int64())],
                                           fields=[pa.field("start", pa.int64()), pa.field("length", pa.int64())])
        return pa.table([pa.array(ids, pa.int64()), pa.array(c.ends - c.starts, pa.int64()),
                         lists(spans, np.bincount(doc, minlength=len(ids))), pa.array(kept, pa.binary())], names=names)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        cut, "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
