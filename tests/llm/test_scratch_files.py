"""Shuffle files of steps that are over are gone before the last step of an operator runs."""

import random
import time
from pathlib import Path

from trailmark.llm import lines, suffixes
from trailmark.llm.common import release


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def left_over(spark, build):
    """Files of the shuffles that ``build`` ran, some seconds after it returned its frame."""
    release(spark)
    time.sleep(1)
    before = shuffle_files(spark)
    out = build()
    until = time.time() + 8
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return out, left


def rows(spark, n=60):
    rng = random.Random(3)
    same = " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) + (same if i % 3 else "") for i in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_segments_are_gone_before_the_chunks_are_cut(spark):
    out, left = left_over(spark, lambda: suffixes.removed(rows(spark)))
    assert not left
    assert out.count() == 60


def test_prefix_lists_lie_in_shuffle_files_a_block_at_a_time(spark, monkeypatch):
    """Candidate pairs of the line stage: with words in blocks the shuffle files are at most half of all lists at once."""
    rng = random.Random(4)
    lines_ = ["\n".join(" ".join(f"w{rng.randrange(9000)}" for _ in range(40)) for _ in range(40)) for _ in range(100)]
    classes = lines.class_table(lines.classed(spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string")))
    monkeypatch.setattr(lines, "written", lines.written)  # undone at the end
    limit = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        peak = lists_at_once(spark, monkeypatch, classes)
    finally:
        spark.conf.set(limit, was)
    assert peak[1] < 0.6 * peak[0], peak


def lists_at_once(spark, monkeypatch, classes):
    """The most bytes of shuffle files while pairs are formed with one block of words, and with the usual number."""
    real, peak = lines.written, []
    for blocks in (1, lines.__dict__.get("WORD_BLOCKS", 1)):
        release(spark)
        time.sleep(1)
        before, seen = shuffle_files(spark), []

        def now():
            seen.append(sum(f.stat().st_size for f in shuffle_files(spark) - before if f.exists()))

        def noted(df, name):
            out = real(df, name)
            now()
            return out

        monkeypatch.setattr(lines, "WORD_BLOCKS", blocks, raising=False)
        monkeypatch.setattr(lines, "written", noted)
        lines.candidates(classes).count()
        now()
        peak.append(max(seen))
    return peak
