"""Packing of tokenized documents into fixed windows, best-fit decreasing (operator 10).

Documents are tokenized where they lie; only piece records (id, start, length,
checksum) move.  A document longer than the window is first cut into full windows
and a rest.  Pieces are dealt at random to shards of bounded size, and each shard
places its pieces by falling length: a segment tree over the remaining capacities
finds the tightest open window that still takes the piece.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each on its own; a null id is carried as null; other columns are ignored.
Ties in length are taken in the order of the shard's rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import give_back, giving_back, slices, written

WINDOW = 4096
END_ID = 2
SHARD_PIECES = 40_000
CACHED_WORDS = 100_000  # words of a generation of a worker's cache, and those of one slice
LEARNED = 20_000  # new words in hand at a time
CHUNK = 4 << 20  # bytes of text whose words are looked up together; a longer text is cut at spaces

# Text of these characters is stable under the tokenizer's normaliser, and splits as WORD says.
# Lines of words: those that hold anything else, or a special token's mark, go through the whole tokenizer.
ODD = re.compile(r"^[^\n]*(?:[^\x21-\x7eÀ-ÖØ-öø-ÿ\n]|<\|)[^\n]*$", re.MULTILINE)
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")


class Remembered(dict):
    """A mapping of two generations: a full one becomes the old one, from which what is asked for again comes back."""

    def __init__(self, most: int = CACHED_WORDS):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def unknown(self, keys) -> list:
        return [k for k in keys if k not in self and k not in self.old]


class Words:
    """Token ids of white-space separated words, remembered: the tokenizer never merges across white space.

    A word of plain letters is split as the tokenizer's own pattern splits it
    and each part is encoded once; any other word goes through the whole
    tokenizer, which is never changed in what it returns.  The different words of
    many texts are learned together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.normalizers import Sequence

        # one vocabulary in memory, used in two ways
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.parts = Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_word, self.of_part = Remembered(), Remembered()

    def _use(self, way: tuple) -> None:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = way

    def _encode_parts(self, parts: list[str]) -> None:
        self._use(self.parts)
        for i in range(0, len(parts), 2000):
            some = parts[i:i + 2000]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, which = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids, np.int64)
            cut = (np.searchsorted(which, np.arange(len(some) + 1)) * 4).tolist()
            for p, a, z in zip(some, cut, cut[1:]):
                self.of_part[p] = ids[a:z]

    def learn(self, words: list[str]) -> None:
        """Afterwards each of ``words`` (none holds a line feed) is in one of the two generations."""
        self.of_word.turn()
        self.of_part.turn()
        give_back()  # of the slice before: workers of other steps wait beside this one
        new = self.of_word.unknown(words)
        for i in range(0, len(new), LEARNED):
            self._learn(new[i:i + LEARNED])

    def _learn(self, new: list[str]) -> None:
        known = self.of_part
        known["\n"] = b""
        odd = set(ODD.findall("\n".join(new)))
        plain = [w for w in new if w not in odd] if odd else new
        parts = WORD.findall("\n".join(plain).lower())
        self._encode_parts(known.unknown(set(parts)))
        ids = list(map(known.__getitem__, parts))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        line = np.flatnonzero(np.fromiter((p == "\n" for p in parts), bool, len(parts)))
        cut = [0, *ends[line].tolist(), int(ends[-1]) if len(ends) else 0]
        whole = b"".join(ids)
        self.of_word.update(zip(plain, [whole[a:z] for a, z in zip(cut, cut[1:])]))
        odd = list(odd)
        self._use(self.whole)
        for i in range(0, len(odd), 2000):
            some = odd[i:i + 2000]
            for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self.of_word[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The texts' ids as little-endian unsigned 32-bit numbers: each different word looked up once, then taken."""
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        del lists  # the words of a slice are several times its text
        different, words = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices
        self.learn(different)
        found = pa.array(list(map(self.of_word.__getitem__, different)), pa.large_binary()).take(words)
        del different, words
        if len(found) == 0:
            return [b""] * len(texts)
        ends = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1]
        at = ends[np.concatenate([[0], np.cumsum(size)])].tolist()
        data = memoryview(found.buffers()[2]) if found.buffers()[2] is not None else memoryview(b"")
        return [bytes(data[a:z]) for a, z in zip(at, at[1:])]

    def ids_of_long(self, text: str) -> bytes:
        """As ``ids``, for a text of any length: piece by piece, cut at white space, which has no ids."""
        out, at = [], 0
        while at < len(text):
            to = at + CHUNK
            if to < len(text):
                ends = [e for e in (text.find(" ", to), text.find("\n", to)) if e >= 0]
                to = min(ends, default=len(text))
            out += self.ids(pa.array([text[at:to]], pa.large_string()))
            at = to + 1
        return b"".join(out)


_words: dict[str, Words] = {}


def words_for(path: str) -> Words:
    """One cache per worker process and vocabulary file."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                      T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           end_id: int = END_ID, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per piece of a document's ids: full windows, then the rest."""
    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField("doc_id", id_field.dataType), *PIECE.fields])

    def cut(batches):
        import pyarrow.compute as pc

        words = words_for(tokenizer_path(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", CHUNK):
            texts = pc.fill_null(batch.column(1), "")
            found = words.ids_of_long(texts[0].as_py()) if batch.num_rows == 1 else None  # a slice of more rows is short
            which, rows = [], []
            for k, ids in enumerate(words.ids(texts) if found is None else [found]):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s:4 * (s + window)]
                    which.append(k)
                    rows.append((s, len(part) // 4, zlib.crc32(part), n))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), *[pa.array(cols[:, i]) for i in range(4)]],
                names=[f.name for f in schema.fields])
        words.of_word.forget()  # the worker goes on to other work; the parts, from which words are made, stay

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        giving_back(cut), schema)


class OpenWindows:
    """Segment tree over remaining capacities 1..n-1: how many open windows have each."""

    def __init__(self, window: int):
        self.size = 1 << int(window).bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, where: int) -> None:
        self.at[capacity].append(where)
        i = capacity + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the open window with the least capacity >= need."""
        i, tree = need + self.size, self.tree
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # climb until a right sibling has something
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        where = self.at[capacity].pop()
        while i:
            tree[i] -= 1
            i >>= 1
        return capacity, where


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of each piece."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, n = OpenWindows(window), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        if found := open_windows.tightest(need):
            capacity, where = found
        else:
            capacity, where, n = window, n, n + 1
        seq[k], offset[k] = where, window - capacity
        if capacity > need:
            open_windows.add(capacity - need, where)
    return seq, offset


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           end_id: int = END_ID, tokenizer: str = "word_bpe_49k.json", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``.

    The pieces are written once (shared folder), counted, and dealt to
    ``count / shard_pieces`` shards by a hash of their row number, so no shard
    depends on a key.  ``sequence_id`` is the shard's number times 2**32 plus
    the window's number in the shard.
    """
    table = written(pieces(docs, id_col, text_col, window, end_id, tokenizer)
                    .withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-table.count() // shard_pieces))
    id_type = table.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *PIECE.fields,
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        seq, offset = best_fit_decreasing(group.column("length").to_numpy(), window)
        shard = group.column("shard")[0].as_py()
        return (group.drop_columns(["row", "shard"]).append_column("sequence_id", pa.array(seq + (shard << 32)))
                .append_column("offset", pa.array(offset)))

    return table.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInArrow(
        place, schema)
