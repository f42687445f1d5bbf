"""Line de-duplication by an exact set-similarity join, DataFrame functions only (operator 6).

A line is the set of its white-space separated words.  Two lines match if the
Jaccard similarity of their sets is 0.8 or more, and a line is removed if a line
before it (smaller document id, or same document and smaller line number) matches
it.  Lines of fewer than ``least`` different words are never compared: five by
default, as in the query's SQL; the pipeline compares every line of a word or more.

Equal sets are one class.  A class is joined with others over its prefix: its
words in order of rarity, of which so many come first that a match must share one
of them.  Length and positional filters follow, then a bitmap filter (128 bits of
word parity, of which two sets differ in no more than they differ in words; 64 bits
tell nothing of lines of over a hundred words, which differ in half of them by
chance), and then the Jaccard similarity of the whole word sets, words standing for themselves as
64-bit hashes.  The order of rarity need only be the same for all lines, so
word counts are kept in a table of fixed size (counts of hashed words), which is
the only thing that every task gets.

Defined results: null or empty texts have no lines to remove; rows that share an
id (also null, which comes first) share their place, so neither precedes the other
at equal line numbers, and each has its row in the result; repeated lines inside a
document match like any others; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import written

LEAST_WORDS = 1
BUCKETS = 1 << 20
FILTER_BITS = 1 << 23
#: pairs are confirmed in so many blocks, so that this part of their word sets lies in shuffle files at a time
BLOCKS = 4
#: so are the words of the prefixes, each block with its lists in shuffle files at a time
WORD_BLOCKS = 3
#: white space within a line, besides the blank
SPACES = "\t\x0b\x0c\r"
#: similarity as whole numbers: NUM / DEN = 0.8
NUM, DEN = 4, 5


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def blanks(text: Column) -> Column:
    """``text`` with a blank for each white space but the line ends: a split at one blank needs no regular expression."""
    out = text
    for x in SPACES:
        out = F.replace(out, F.lit(x), F.lit(" "))
    # one look at the text spares those without such characters a pass for each
    return F.when(text.rlike(f"[{SPACES}]"), out).otherwise(text)


def words(line: Column) -> Column:
    """Words of a line of ``blanks()``; those between two blanks are empty."""
    return F.split(line, " ", -1)


def bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(BUCKETS - 1)


def text_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, line_no, line) of every line, with blanks for white space; ``row`` tells texts that share an id."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.select("doc_id", F.xxhash64("text").alias("row"),
                       F.posexplode_outer(split_lines(blanks(F.col("text")))).alias("line_no", "line"))


def rarity(docs: DataFrame, text_col: str) -> Column:
    """Array of ``BUCKETS`` ranks: twice the binary logarithm of how many words of the corpus fall into each.

    A scalar subquery over a grouped count of fixed size (four megabytes).  Line
    ends part words too, so whole texts are split at once.
    """
    text = F.replace(blanks(F.col(text_col).cast("string")), F.lit("\n"), F.lit(" "))
    counts = (docs.select(F.explode(words(text)).alias("word")).groupBy(bucket(F.col("word")).alias("b"))
              .agg(F.floor(2 * F.log2(F.count("*"))).cast("int").alias("rank")))
    return table_of(counts, "b", "rank", BUCKETS, F.lit(0))


def word_codes(line: Column, ranks: Column) -> Column:
    """The line's different words as sorted numbers: rarity in the top bits, 56 bits of hash below.

    One function over the words makes the numbers; what follows is generated code
    over arrays without nulls.
    """
    low, none = F.lit((1 << 56) - 1), F.lit(-1).cast("long")

    def code(word: Column) -> Column:
        # ``ranks`` stands here once: a second use would make it a column, copied with every line
        rank = F.coalesce(F.get(ranks, bucket(word)), F.lit(0)).cast("long")
        return F.when(word == "", none).otherwise(F.shiftleft(rank, 56).bitwiseOR(F.xxhash64(word).bitwiseAND(low)))

    return F.sort_array(F.array_remove(F.array_distinct(F.transform(words(line), code)), none))


def word_hashes(line: Column) -> Column:
    """The line's different words as 64-bit hashes."""
    hashes = F.array_distinct(F.transform(words(line), lambda x: F.xxhash64(x)))
    return F.array_remove(hashes, F.xxhash64(F.lit("")))


def shifted(x: Column, by: Column, name: str = "shiftleft") -> Column:
    return F.call_function(name, x, by.cast("int"))


def parity(codes: Column, half: int) -> Column:
    """One half of 128 bits: the parity of how many words fall on each."""
    flip = F.lit(1 - half).cast("long")

    def add(acc: Column, x: Column) -> Column:
        mine = F.shiftright(x, 6).bitwiseXOR(flip).bitwiseAND(F.lit(1).cast("long"))
        return acc.bitwiseXOR(shifted(mine, x.bitwiseAND(63)))

    return F.aggregate(codes, F.lit(0).cast("long"), add)


def table_of(df: DataFrame, key: str, value: str, size: int, none: Column) -> Column:
    """A scalar array of ``size`` values from a grouped frame, ``none`` where a key is absent."""
    every = df.sparkSession.range(size).select(F.col("id").alias(key))
    full = every.join(df.select(F.col(key).cast("long").alias(key), value), key, "left").select(
        key, F.coalesce(F.col(value), none).alias(value))
    listed = full.agg(F.sort_array(F.collect_list(F.struct(key, value))).alias("x"))
    return listed.select(F.transform("x", lambda x: x[value]).alias("x")).scalar()


def among(wanted: DataFrame, cols: list[str]):
    """A function that adds a column to a frame: true for every row of ``wanted`` (and for few others while its 2**23 bits
    are sparse), so that a join with ``wanted`` deals out few rows."""
    place = lambda: F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))
    at = wanted.select(place().alias("h"))
    words = at.groupBy(F.shiftright("h", 6).alias("w")).agg(
        F.bit_or(shifted(F.lit(1).cast("long"), F.col("h").bitwiseAND(63))).alias("m"))
    bits = table_of(words, "w", "m", FILTER_BITS // 64, F.lit(0).cast("long"))

    def marked(df: DataFrame, name: str = "in") -> DataFrame:
        df = df.withColumn("__h", place()).withColumn("__bits", bits)
        word = F.get("__bits", F.shiftright("__h", 6).cast("int"))
        bit = shifted(word, F.col("__h").bitwiseAND(63), "shiftrightunsigned").bitwiseAND(1)
        return df.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__h", "__bits")

    return marked


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, line_no, k1, k2, size, prefix, p, q) of every line, written.

    ``k1``/``k2`` are a 128-bit key of the word set, null for a line too short to
    compare; ``prefix`` the 32-bit codes of its rarest words; ``p`` and ``q`` its
    parity bits.
    """
    lines = text_lines(docs, id_col, text_col)
    ranks = rarity(docs, text_col)
    codes = lines.withColumn("ranks", ranks).select("doc_id", "row", "line_no", word_codes(F.col("line"), F.col(
        "ranks")).alias("codes"))
    # the generator keeps the codes of a line from being computed once for each use
    codes = codes.select("doc_id", "row", "line_no", F.explode(F.array("codes")).alias("codes"))
    long_enough = F.size("codes") >= least
    prefix = F.transform(F.slice("codes", 1, F.floor(F.size("codes") / DEN).cast("int") + 1), lambda x: F.hash(x))
    out = codes.select(
        "doc_id", "row", "line_no", F.when(long_enough, F.xxhash64("codes")).alias("k1"),
        F.when(long_enough, F.xxhash64(F.lit(1), "codes", F.lit(2))).alias("k2"), F.size("codes").alias("size"),
        F.when(long_enough, prefix).alias("prefix"),
        *[F.when(long_enough, parity(F.col("codes"), half)).alias(c) for half, c in enumerate("pq")])
    return written(out, "line-classes")


def class_table(lines: DataFrame) -> DataFrame:
    """One row per class: ``cid``, its key, size, prefix, first place and how many lines it has; written."""
    place = F.struct("doc_id", "line_no", "row")
    out = (lines.filter("k1 is not null").groupBy("k1", "k2")
           .agg(F.min(place).alias("first"), F.count("*").alias("n"),
                *[F.first(c).alias(c) for c in ("size", "prefix", "p", "q")]))
    return written(out.withColumn("cid", F.monotonically_increasing_id()), "line-class")


def postings(classes: DataFrame, block: int) -> DataFrame:
    """(cid, size, p, q, first, pos, word) of every word of a prefix that falls into a block of words; ``first``: the first
    place without its text's hash.  Sets of fewer than four words match equal sets only, which are one class."""
    every = classes.filter((DEN - NUM) * F.col("size") >= NUM).select(
        "cid", "size", "p", "q", F.struct("first.doc_id", "first.line_no").alias("first"),
        F.posexplode("prefix").alias("pos", "word"))
    return every.filter(F.pmod(F.xxhash64("word"), F.lit(WORD_BLOCKS)) == block)


def side(post: DataFrame, x: str) -> DataFrame:
    return post.select("word", F.col("cid").alias(x), F.col("size").alias(f"s{x}"), F.col("pos").alias(f"i{x}"),
                       F.col("p").alias(f"p{x}"), F.col("q").alias(f"q{x}"), F.col("first").alias(f"f{x}"))


def near(sides: DataFrame, order: Column) -> DataFrame:
    """(a, b, s): pairs of classes (two sides that share a prefix word) that stand in ``order`` and pass the length,
    positional and bitmap filters; ``s``: the sum of their sizes.

    The prefix of a class is size - ceil(0.8 size) + 1 words; the positional
    filter cuts it to what a pair of these two sizes needs.
    """
    both = F.col("sa") + F.col("sb")
    alike = DEN * F.least("sa", "sb") >= NUM * F.greatest("sa", "sb")
    # at the first shared word no more than the rest of the shorter tail can be shared
    enough = (DEN + NUM) * F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib")) >= NUM * both
    apart = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) + F.bit_count(F.col("qa").bitwiseXOR(F.col("qb")))
    close = (DEN + NUM) * apart <= (DEN - NUM) * both
    return sides.filter(order & alike & enough & close).groupBy("a", "b").agg(F.min(both).alias("s"))


def met(a: DataFrame, b: DataFrame, order: Column) -> DataFrame:
    return near(a.join(b, "word"), order)


def gathered(pairs: Callable[[int], DataFrame]) -> DataFrame:
    """The pairs of all blocks of words, each block written before the next one's lists are dealt out; written."""
    parts = [written(pairs(block), "line-pairs") for block in range(WORD_BLOCKS)]
    return written(reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.min("s").alias("s")), "line-pairs")


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs of classes (a: not smaller than b).  Both sides are the same postings, so they are dealt out once."""
    larger = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") > F.col("b")))

    def pairs(block: int) -> DataFrame:
        post = postings(classes, block)
        return met(side(post, "a").drop("fa"), side(post, "b").drop("fb"), larger)

    return gathered(pairs)


def links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str = "doc_id",
          text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Those of the written ``pairs`` (a, b, s) whose word sets have a Jaccard similarity of 0.8 or more, and the rows of
    ``classes`` that are in pairs; both written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    some = among(wanted, ["cid"])(classes.select("cid", "k1", "k2", "first", "n")).filter("`in`").drop("in")
    places = written(some.join(wanted, "cid"), "line-places")
    of = places.select("cid", F.col("first.doc_id").alias("d"), F.col("first.row").alias("r"),
                       F.col("first.line_no").alias("l"))
    lines = among(of.select(F.col("d").alias("doc_id"), F.col("r").alias("row"), F.col("l").alias("line_no")),
                  ["doc_id", "row", "line_no"])(text_lines(docs, id_col, text_col)).filter("`in`")
    same = (lines["line_no"] == of["l"]) & (lines["row"] == of["r"]) & lines["doc_id"].eqNullSafe(of["d"])
    found = lines.join(of, same).select("cid", word_hashes(F.col("line")).alias("words")).dropDuplicates(["cid"])
    sets = written(found, "line-sets")
    left = sets.select(F.col("cid").alias("a"), F.col("words").alias("wa"))
    right = sets.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    out = None
    for i in range(BLOCKS):
        here = F.pmod(F.xxhash64("a"), F.lit(BLOCKS)) == i
        both = pairs.filter(here).join(left.filter(here), "a").join(right, "b")
        part = written(both.filter((DEN + NUM) * common >= NUM * F.col("s")).select("a", "b"), "line-links")
        out = part if out is None else out.unionByName(part)
    return out, places


def matched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, line_no, removed, n_links, source) of every line.

    ``n_links``: how many other lines match it; ``source``: document of the first
    line that matches it, null unless removed.
    """
    lines = classed(docs, id_col, text_col, least)
    classes = class_table(lines)
    pairs, places = links(docs, candidates(classes), classes, id_col, text_col)
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = places.select(F.col("cid").alias("b"), F.col("first").alias("f"), F.col("n").alias("m"))
    linked = ways.join(of, "b").groupBy(F.col("a").alias("cid")).agg(F.min("f").alias("f"), F.sum("m").alias("m"))
    # lines of other classes match a class, and the lines of its own
    others = places.join(linked, "cid").select("k1", "k2", F.least("first", "f").alias("f"), "m")
    own = classes.filter("n > 1").select("k1", "k2", F.col("first").alias("f"), (F.col("n") - 1).alias("m"))
    full = others.unionByName(own).groupBy("k1", "k2").agg(F.min("f").alias("f"), F.sum("m").alias("n_links"))
    before = (F.col("f.doc_id").isNull() & F.col("doc_id").isNotNull()) | (F.col("f.doc_id") < F.col("doc_id")) | (
        F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f.line_no") < F.col("line_no")))
    removed = F.coalesce(F.col("f").isNotNull() & before, F.lit(False))
    return lines.join(full, ["k1", "k2"], "left").select(
        "doc_id", "row", "line_no", removed.alias("removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(removed, F.col("f.doc_id")).alias("source"))


def by_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row for each different (document id, text), with ``copies``, how many rows have both."""
    m = matched(docs, id_col, text_col, least)
    # each row has a first line, or none where its text is null
    copies = F.count(F.when(F.coalesce("line_no", F.lit(0)) == 0, 1))
    return m.groupBy("doc_id", "row").agg(
        copies.alias("copies"), F.coalesce(F.min(F.least("doc_id", "source")), F.first("doc_id")).alias("class_id"),
        F.expr("sum(n_links)").alias("n_links"), F.count("line_no").alias("n_lines"),
        F.count(F.when(F.col("removed"), 1)).alias("n_removed"),
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("line_no")))).alias("removed")).withColumns(
        {c: F.expr(f"{c} div copies") for c in ("n_links", "n_lines", "n_removed")})


def by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: ``class_id`` (least id among the sources of its removed lines and itself), ``n_links``,
    ``n_lines``, ``n_removed`` and the ``removed`` line numbers."""
    rows = by_row(docs, id_col, text_col, least)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def earlier(a: Column, b: Column) -> Column:
    """Whether place ``a`` stands before place ``b`` (null ids first; rows that share an id share their places)."""
    same = a["doc_id"].eqNullSafe(b["doc_id"])
    before = (a["doc_id"].isNull() & b["doc_id"].isNotNull()) | F.coalesce(a["doc_id"] < b["doc_id"], F.lit(False))
    return before | (same & (a["line_no"] < b["line_no"]))


def preceded(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cid) of every class that matches a class which stands before it; exact, without the links among the rest.

    First each class is compared with the classes that stand first in the lists of its prefix words.  Those that match
    one are done, whatever else they match; the others are then compared with all classes before them in those lists.
    A group of near copies is thus settled by its first member, and its pairs grow with its size, not the square.
    """
    before = earlier(F.col("fb"), F.col("fa"))

    def with_heads(block: int) -> DataFrame:
        # a window deals the postings out once; a grouped table of the heads would be dealt out beside them
        head = F.min(F.struct("first", "cid", "size", "p", "q", "pos")).over(Window.partitionBy("word"))
        names = dict(a="cid", sa="size", ia="pos", pa="p", qa="q", fa="first")
        return near(postings(classes, block).withColumn("h", head).select(
            *[F.col(c).alias(x) for x, c in names.items()],
            *[F.col(f"h.{c}").alias(x.replace("a", "b")) for x, c in names.items()]), before)

    found, _ = links(docs, gathered(with_heads), classes, id_col, text_col)
    done = written(found.select(F.col("a").alias("cid")).distinct(), "line-settled")
    told = among(done, ["cid"])(classes)
    left = told.filter("not `in`").unionByName(told.filter("`in`").join(done, "cid", "left_anti")).drop("in")
    found, _ = links(docs, gathered(lambda block: met(
        side(postings(left, block), "a"), side(postings(classes, block), "b"), before)), classes, id_col, text_col)
    return done.unionByName(found.select(F.col("a").alias("cid")).distinct())


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, removed): the numbers of the removed lines of each text that loses any."""
    lines = classed(docs, id_col, text_col, least)
    classes = class_table(lines)
    gone = written(preceded(docs, classes, id_col, text_col), "line-gone")
    some = among(gone, ["cid"])(classes).filter("`in` or n > 1").select("cid", "k1", "k2", F.col("first").alias("f"), "n")
    known = some.join(gone.withColumn("gone", F.lit(True)), "cid", "left").filter("gone or n > 1").select("k1", "k2", "f", "gone")
    place = F.struct("doc_id", "line_no")
    hit = lines.select("doc_id", "row", "line_no", "k1", "k2").join(known, ["k1", "k2"]).filter(
        F.col("gone") | earlier(F.col("f"), place))
    return hit.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the removed lines, same columns; a document that loses all its lines goes.

    A column named ``n_chars`` is brought up to date.
    """
    gone = (removals(docs, id_col, text_col, least)
            .select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), F.col("removed").alias("__x")))
    same = docs[id_col].eqNullSafe(gone["__d"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__r"])
    rest = F.array_join(F.filter(split_lines(F.col(text_col)), lambda x, i: ~F.array_contains("__x", i)), "\n")
    out = docs.join(gone, same, "left").withColumn(text_col, F.when(F.col("__x").isNull(), F.col(text_col)).otherwise(rest))
    out = out.filter(F.col("__x").isNull() | (F.trim(text_col) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__x").isNull(), F.col("n_chars")).otherwise(
            F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
