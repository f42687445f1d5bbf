"""Merkle manifest of a dataset over bitmap ranks (operator 12).

Every row is a leaf; the leaves of a group, ascending by id, fold sixteen at a
time into the group's subroot, and the subroots into the root.  No leaf is ever
sorted into its place.  The ids of a group form a bitmap that is kept word by
word (64 ids; empty words are not stored), merged by bitwise OR and covered by a
directory of popcounts: for each word the number of leaves before it, from
running sums within ranges of words, ranges of ranges and so on, so that no
running sum spans more than 65,536 entries however large a group is.  A leaf's
coordinate is a rank query, its word's base plus the popcount below its own bit.
Leaves then go by (group, coordinate div ``SPAN``) into arrays keyed by slot,
each of which folds its levels in one go; the arrays' tops are reduced likewise.
Downwards, each array hands its slots their siblings, so that a leaf's proof is
put together from its own array and what was handed to that.

Defined results: fields that are null are hashed as ``-``; rows of a null id come
first in their group and count as the least id; rows of one group and id stand in
order of their leaf's digest, copies of one row beside each other, one row out
for each row in; a null group comes first and is not the group of empty text; an
empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import crc_mod, release, written

FAN = 16
SPAN = FAN * FAN  # leaves of an array: two levels
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: bits of an id below each step of the directory: a word, 1,024 words, then 65,536 entries at a time
WORD, STEPS = 6, (10, 16, 16, 16)

_LEAST = -2 ** 63
_PATH = "array<struct<before: string, after: string>>"
BLOCK = "grp string, block long, total long, ids array<long>, nodes array<string>, lows array<string>, top string"
PROOF = ("grp string, position long, id long, leaf string, subroot string, root string, siblings array<string>, "
         "proof_sha256 string, folded_root string, verified boolean")


def field(column):
    """A field as hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(columns: list):
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def lowered(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, altered=None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
           fields: tuple = FIELDS) -> DataFrame:
    """(grp, id, leaf, low, m): each different leaf, its digest after tampering where that differs, its copies.

    ``grp`` is the empty text for a null group and ``=`` before any other, so that it sorts as the groups should.
    ``altered`` says which rows are tampered with (a condition): their text's A-Z are lower-cased.
    """
    altered = F.lit(False) if altered is None else altered
    text = F.col(text_col)
    low = F.when(altered & text.rlike("[A-Z]"),
                 digest([lowered(text) if c == text_col else F.col(c) for c in fields]))
    return (docs.select(F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
                        F.col(id_col).cast("long").alias("id"), digest([F.col(c) for c in fields]).alias("leaf"),
                        low.alias("low"))
            .groupBy("grp", "id", "leaf", "low").agg(F.count("*").alias("m"))
            .withColumn("key", F.coalesce("id", F.lit(_LEAST))))


def running(counts: DataFrame, group: list[str], steps: tuple = STEPS) -> DataFrame:
    """``counts`` (group, k, n) with ``base``, the sum of n over smaller k of the group, and ``total``, over all."""
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy(*group, *(["up"] if steps else [])).orderBy("k").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    if not steps:
        return counts.withColumn("base", before).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    own = counts.withColumn("up", F.shiftright("k", steps[0]))
    above = running(own.groupBy(*group, F.col("up").alias("k")).agg(F.sum("n").alias("n")), group, steps[1:])
    above = above.select(*group, F.col("k").alias("up"), F.col("base").alias("base_up"), "total")
    return (own.withColumn("base", before).join(above, [*group, "up"])
            .withColumn("base", F.col("base") + F.col("base_up")).drop("up", "base_up"))


def directory(rows: DataFrame, group: list[str]) -> DataFrame:
    """Bitmap words of each group's ``key``s (with counts ``m``) and how many rows stand before each word.

    ``more`` lists the keys of a word that have several rows: (bit, rows beyond the first).
    """
    by_key = rows.groupBy(*group, "key").agg(F.sum("m").alias("n"))
    bit = F.col("key").bitwiseAND(63).cast("int")
    words = (by_key.withColumn("bit", bit)
             .groupBy(*group, F.shiftright("key", WORD).alias("k"))
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"),
                  F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("n")))).alias("more")))
    return running(written(words, "merkle-words"), group)


def ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (group, key, m) with ``position``, the rows of the group with a smaller key, ``own``, those of
    their own key, and the group's ``total``: a rank query for each row, no order among the rows."""
    words = directory(rows, group)
    found = (rows.withColumn("k", F.shiftright("key", WORD)).withColumn("bit", F.col("key").bitwiseAND(63).cast("int"))
             .join(words.drop("n"), [*group, "k"]))
    zero = F.lit(0).cast("long")
    extra = F.aggregate("more", zero, lambda acc, e: acc + F.when(e["bit"] < F.col("bit"), e["n"]).otherwise(zero))
    own = F.aggregate("more", F.lit(1).cast("long"),
                      lambda acc, e: acc + F.when(e["bit"] == F.col("bit"), e["n"]).otherwise(zero))
    return (found.withColumn("position", F.col("base") + F.expr("bit_count(bits & ~shiftleft(-1L, bit))") + extra)
            .withColumn("own", own).drop("k", "bit", "bits", "more", "base"))


def coordinates(rows: DataFrame) -> DataFrame:
    """(grp, id, leaf, low, position, total): one row for each leaf and copy."""
    cols = ["grp", "id", "leaf", "low", "position", "total"]
    at = written(ranked(rows, ["grp"]), "merkle-ranks")
    alone = at.filter("own = 1").select(*cols)
    shared = at.filter("own > 1")
    if shared.isEmpty():
        return alone
    # several rows of one group and id: their digests (uniform numbers) are ranked the same way within the id
    number = F.conv(F.substring("leaf", 1, 16), 16, 10).cast("decimal(20,0)") + F.lit(_LEAST).cast("decimal(20,0)")
    inner = shared.select("grp", "leaf", "low", "id", F.col("key").alias("of"), "m", F.col("position").alias("first"),
                          F.col("total").alias("all"), number.cast("long").alias("key"))
    inner = ranked(inner, ["grp", "of"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))
    inner = inner.withColumn("copy", copies).withColumn("position", F.col("first") + F.col("position") + F.col("copy"))
    return alone.unionByName(inner.withColumn("total", F.col("all")).select(*cols))


def hashed(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def folded(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The levels over ``nodes``: so many, or until one node remains (None)."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([hashed(last[i:i + FAN]) for i in range(0, len(last), FAN)])
    return out


def levels_of(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """Levels of an array: both where its group has further arrays, else until one node remains."""
    return folded(nodes, 2 if total > SPAN else None)


def arrays(nodes: DataFrame) -> DataFrame:
    """Slot arrays of ``SPAN`` neighbours of a group, scattered by position, with the node they fold into."""

    def scatter(table: pa.Table) -> pa.Table:
        at = table.column("position").to_numpy()
        slot = at % SPAN
        into = np.empty(len(slot), np.int64)
        into[slot] = np.arange(len(slot))  # positions of an array are gapless, so each slot is filled once
        rows = table.take(pa.array(into))
        total = rows.column("total")[0].as_py()
        leaf = rows.column("node").to_pylist()
        top = levels_of([x.encode() for x in leaf], total)[-1][0].decode()
        return pa.table({
            "grp": rows.column("grp")[:1], "block": pa.array([int(at[0]) // SPAN], pa.int64()),
            "total": rows.column("total")[:1], "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())),
            "nodes": pa.array([leaf], pa.list_(pa.string())),
            "lows": pa.array([rows.column("low").to_pylist()], pa.list_(pa.string())), "top": pa.array([top])})

    block = F.expr(f"position div {SPAN}").alias("array_no")
    return nodes.groupBy("grp", block).applyInArrow(scatter, BLOCK)


def reduced(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """Arrays of each step from the leaves up, and (grp, top, height): each group's last node and its step."""
    steps, tops = [], None
    widest = None
    while True:
        level = written(arrays(nodes), f"merkle-{name}-{len(steps)}")
        if widest is None:
            widest = level.agg(F.max("total")).first()[0]
            if widest is None:
                return [], None
        done = level.filter(F.col("total") <= SPAN).select("grp", "top", F.lit(len(steps)).alias("height"))
        tops = done if tops is None else tops.unionByName(done)
        steps.append(level)
        if widest <= SPAN:
            return steps, tops
        nodes = level.filter(F.col("total") > SPAN).select(
            "grp", F.lit(None).cast("long").alias("id"), F.col("top").alias("node"), F.lit(None).cast("string").alias("low"),
            F.col("block").alias("position"), F.expr(f"(total + {SPAN - 1}) div {SPAN}").alias("total"))
        widest = -(-widest // SPAN)


def beside(levels: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """(siblings before, siblings after) of a slot on each level of its array."""
    out = []
    for nodes in levels[:-1]:
        run = slot // FAN * FAN
        out.append((b"".join(nodes[run:slot]), b"".join(nodes[slot + 1:run + FAN])))
        slot //= FAN
    return out


def single(batches):
    """The rows one by one, so that one array at a time is unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def handed(level: DataFrame, paths: DataFrame) -> DataFrame:
    """(grp, block, upper, subroot) of the arrays below: what their array above hands to each of its slots."""

    def each(batches):
        for r in single(batches):
            levels = levels_of([x.encode() for x in r["nodes"]], r["total"])
            n = len(r["nodes"])
            upper = [[*({"before": a.decode(), "after": z.decode()} for a, z in beside(levels, i)), *r["upper"]]
                     for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["grp"]] * n), pa.array(np.arange(n) + r["block"] * SPAN),
                 pa.array(upper, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                 pa.array([r["subroot"]] * n, pa.string())], names=["grp", "block", "upper", "subroot"])

    cols = ["grp", "block", "total", "nodes", "upper", "subroot"]
    return level.join(paths, ["grp", "block"]).select(*cols).mapInArrow(
        each, f"grp string, block long, upper {_PATH}, subroot string")


def lowest(steps: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Paths of the arrays of leaves, from ``heads`` (grp, height, upper, subroot): each group's last array."""
    paths = None
    for k in range(len(steps) - 1, -1, -1):
        here = heads.filter(F.col("height") == k).select("grp", F.lit(0).cast("long").alias("block"), "upper", "subroot")
        paths = here if paths is None else here.unionByName(handed(steps[k + 1], paths))
    return paths


def numbered(groups: DataFrame) -> DataFrame:
    """``groups`` with ``position`` and ``total`` in order of ``grp``: range partitions, numbered, and their counts."""
    part = F.spark_partition_id()
    rows = written(groups.orderBy("grp").withColumn("part", part).withColumn(
        "in_part", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)), "merkle-groups")
    parts = running(rows.groupBy(F.lit(0).alias("one"), F.col("part").cast("long").alias("k")).agg(
        F.count("*").alias("n")), ["one"], ())  # one row a partition
    return (rows.withColumn("k", F.col("part").cast("long")).join(parts.select("k", "base", "total"), "k")
            .withColumn("position", F.col("base") + F.col("in_part")).drop("k", "part", "in_part", "base"))


def proofs(docs: DataFrame, altered=None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
           fields: tuple = FIELDS, siblings: bool = False) -> DataFrame:
    """One row a leaf (``PROOF``): its digest and coordinate, its group's subroot, the root, its proof.

    ``folded_root`` is folded from the leaf, or the tampered one, with the original siblings.  The siblings
    themselves, one text a level, come with ``siblings=True``; they are about a kilobyte a level.
    """
    spark = docs.sparkSession
    rows = written(leaves(docs, altered, id_col, group_col, text_col, fields), "merkle-leaves")
    steps, tops = reduced(coordinates(rows).withColumnRenamed("leaf", "node"), "leaves")
    if not steps:
        return spark.createDataFrame([], PROOF)
    order = written(numbered(tops), "merkle-order")
    none = F.lit(None)
    over, root = reduced(order.select(F.lit("").alias("grp"), none.cast("long").alias("id"), F.col("top").alias("node"),
                                      none.cast("string").alias("low"), "position", "total"), "roots")
    root = root.first()["top"]
    first = spark.createDataFrame([("", len(over) - 1, [], "")], f"grp string, height int, upper {_PATH}, subroot string")
    ways = handed(over[0], lowest(over, first)).select(F.col("block").alias("position"), "upper")
    heads = written(order.join(ways, "position").select("grp", "height", "upper", F.col("top").alias("subroot")),
                    "merkle-heads")

    def each(batches):
        for r in single(batches):
            nodes = [x.encode() for x in r["nodes"]]
            levels = levels_of(nodes, r["total"])
            upper = [(u["before"].encode(), u["after"].encode()) for u in r["upper"]]
            lows, texts, sums, ends = r["lows"], [], [], []
            for i, leaf in enumerate(nodes):
                path = beside(levels, i) + upper
                at = lows[i].encode() if lows[i] else leaf
                for before, after in path:
                    at = hashed([before, at, after])
                sums.append(hashed([x for pair in path for x in pair]).decode())
                ends.append(at.decode())
                texts.append([(a + z).decode() for a, z in path] if siblings else None)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["grp"]] * n), pa.array(np.arange(n) + r["block"] * SPAN), pa.array(r["ids"], pa.int64()),
                 pa.array(r["nodes"]), pa.array([r["subroot"]] * n), pa.array([root] * n),
                 pa.array(texts, pa.list_(pa.string())), pa.array(sums), pa.array(ends),
                 pa.array([x == root for x in ends])],
                names=["grp", "position", "id", "leaf", "subroot", "root", "siblings", "proof_sha256", "folded_root",
                       "verified"])

    release(spark)
    return steps[0].join(lowest(steps, heads), ["grp", "block"]).select(
        "grp", "block", "total", "ids", "nodes", "lows", "upper", "subroot").mapInArrow(each, PROOF)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
             fields: tuple = FIELDS) -> DataFrame:
    """``proofs`` with each row tampered with whose crc32(id as text) is divisible by 5 (a null id: the empty text)."""
    return proofs(docs, crc_mod(id_col, 5) == 0, id_col, group_col, text_col, fields).withColumnRenamed("id", id_col)
