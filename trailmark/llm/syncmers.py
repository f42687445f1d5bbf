"""Document fingerprints from closed syncmers, DataFrame functions only (operator 9).

A text's letters are its white-space separated words, each cut every 16
characters.  Of the k-mers of letters those are chosen whose least inner s-mer
(by hash, the leftmost of equal ones) is their first or last: a choice that
depends on the k-mer alone, so equal passages choose equal anchors wherever they
stand, and every run of k - s k-mers holds one.  The fingerprint is the anchors'
hashes in order, eight hexadecimal digits each.

Defined results: a null text is empty; a text of fewer than k letters is one
anchor of all of them, an empty one has the empty fingerprint; likeness is
2 * common / (both), counting distinct anchor hashes, 1 for two
empty fingerprints; repeated ids are ordered by their texts; null ids come first;
ids are whole numbers; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import parts_for, text_bytes

K, S = 5, 2
LETTER = r"[^\x20\x09-\x0D]{1,16}"
#: fixed multipliers and modulus (a prime) of the hashes; products stay below 2**63
MOD = 2147483647
A, B = 1000003, 998244353
C, D, E = 754974721, 469762049, 167772161
PART_BYTES = 16 << 20


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LETTER), F.lit(0))


def letter_codes(text: Column) -> Column:
    """28-bit hash of each letter."""
    return F.transform(letters(text), lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))


def inner(codes: Column) -> Column:
    """Hash of each s-mer (two letters)."""
    n = F.size(codes)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice(codes, 1, n - 1), lambda x, i: (x * A + F.get(codes, i + 1) * B) % MOD))


def anchors(codes: Column, s: Column) -> Column:
    """(position, hash) of each closed syncmer; of all letters together in a shorter text."""
    at = lambda i, j: F.get(s, i + j)
    kmer = lambda i: (at(i, 0) * C + at(i, 2) * D + at(i, 3) * E) % MOD

    def edge(x, i):
        rest = F.least(at(i, 1), at(i, 2))
        first = (x <= rest) & (x <= at(i, 3))
        last = (at(i, 3) < x) & (at(i, 3) < rest)
        return F.when(first | last, F.struct(i.cast("int").alias("pos"), kmer(i).alias("hash")))

    n = F.size(codes)
    short = F.aggregate(codes, F.lit(n).cast("long"), lambda acc, x: (acc * A + x * B) % MOD)
    return (F.when(n == 0, F.array().cast("array<struct<pos:int,hash:bigint>>"))
            .when(n < K, F.array(F.struct(F.lit(0).alias("pos"), short.alias("hash"))))
            .otherwise(F.filter(F.transform(F.slice(s, 1, F.size(s) - (K - S)), edge), lambda x: x.isNotNull())))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the anchors of a text column, each step held in a column of its own (evaluated once)."""
    c, s = f"__{out}_c", f"__{out}_s"
    return (once(once(df, c, letter_codes(F.col(text))), s, inner(F.col(c)))
            .withColumn(out, anchors(F.col(c), F.col(s))).drop(c, s))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that the optimizer does not copy into the expressions that use it."""
    return df.withColumn(name, F.explode(F.array(value)))


def digest(a: Column) -> Column:
    """The anchors in order, as text."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x["hash"]), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """2 * common / (distinct of both); 1 for two empty fingerprints."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def bounds_of(base: DataFrame, n: int) -> list[int]:
    """At most ``n`` ids that exist, the smallest first, that cut the ids into about equal parts."""
    share = [i / n for i in range(1, n)]
    row = base.agg(F.min("place").alias("least"),
                   (F.percentile_approx("place", share, 100 * n) if share else F.array()).alias("cuts")).first()
    return sorted({row["least"], *(row["cuts"] or [])}) if row["least"] is not None else [0]


def part_of(place: Column, bounds: list[int]) -> Column:
    """Number of the last bound <= place, searched in two steps of about sqrt(n)."""
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    coarse = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    g = F.size(F.filter(coarse, lambda x: x <= place))
    return (g - 1) * step + F.size(F.filter(F.element_at(fine, g), lambda x: x <= place)) - 1


def parted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents in ranges of ids (``part``), each range ending with the first document of the next one.

    The bounds are ids that exist, so the document at a bound is the one that
    follows the range before it: it is sent to both (``extra`` marks the copy,
    and the last range gets the very first document).  One shuffle of the texts.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("place", F.coalesce("doc_id", F.lit(-(2 ** 63))))
    bounds = bounds_of(base, parts_for(text_bytes(base), PART_BYTES))
    base = base.withColumn("part", part_of(F.col("place"), bounds))
    first = F.element_at(F.from_json(F.lit(json.dumps(bounds)), "array<bigint>"), F.col("part") + 1) == F.col("place")
    before = F.when(F.col("part") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("part") - 1)
    to = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")),
                                 F.when(first, F.struct(before.alias("part"), F.lit(True).alias("extra")))))
    return base.select("doc_id", "place", "text", F.explode(to).alias("to")).select(
        "doc_id", "place", "text", "to.part", "to.extra").repartition("part")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``anchors`` (position in letters, hash) of every document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(
        "__text"))
    return with_anchors(base, "__text", "anchors").select("doc_id", "anchors")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text (its second half from the next document), and likenesses."""
    df = with_anchors(parted(docs, id_col, text_col), "text", "own")
    w = Window.partitionBy("part").orderBy("extra", "place", F.xxhash64("text"), "text")
    df = (df.withColumn("next", F.lead("text").over(w)).withColumn("following", F.lead("own").over(w))
          .filter(~F.col("extra")))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = once(df, "edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
                                     F.substring(F.col("next"), F.lit(1), half)))
    df = with_anchors(df, "edited", "new")
    for name in ("own", "new", "following"):
        df = once(df, f"{name}_set", F.array_distinct(F.transform(F.col(name), lambda x: x["hash"])))
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                     digest(F.col("own")).alias("fingerprint"), digest(F.col("new")).alias("edited_fingerprint"),
                     likeness(F.col("own_set"), F.col("new_set")).alias("near_edited"),
                     likeness(F.col("own_set"), F.col("following_set")).alias("near_next"))
