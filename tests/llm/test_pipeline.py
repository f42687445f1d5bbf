"""The corpus pipeline against a brute-force version, and its stages on awkward tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from trailmark.llm import packing, quality

SF = "/root/testdata/sf0.001"
CLASH = "score double, predicted int, bad_lines string, n_words string, n_hit long, item_ids string, hit_spans int, removed int, kept int"
DOC = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
OWN = (7.5, 3, "b", "w", 9, "i", 4, 5, 6)


def brute_lines(rows):
    """Rows without lines that match an earlier one; a document that loses all its lines goes."""
    every = [(i, k, set(re.split(r"[\x20\x09-\x0d]+", x)) - {""}) for i, t in rows if t is not None
             for k, x in enumerate(t.split("\n"))]
    by_word = defaultdict(set)
    for n, (_, _, w) in enumerate(every):
        for x in w:
            by_word[x].add(n)
    gone = defaultdict(set)
    for i, k, w in every:
        near = defaultdict(int)
        for x in w:
            for n in by_word[x]:
                near[n] += 1
        if any(every[n][:2] < (i, k) and 5 * c >= 4 * len(w | every[n][2]) for n, c in near.items()):
            gone[i].add(k)
    out = []
    for i, t in rows:
        if i in gone:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            if not t.strip(" "):
                continue
        out.append((i, t))
    return out


def brute_near(rows, width=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return [(i, t) for i, t in rows if root(i) == i]


def brute_clean_of(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    wins = defaultdict(set)
    for t in items:
        w = low(t)
        n = min(10, len(w))
        if n:
            wins[n] |= {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    return [(i, t) for i, t in rows
            if not any(tuple(w[k:k + n]) in s for w in [low(t)] for n, s in wins.items() for k in range(len(w) - n + 1))]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    model = quality.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"))

    def accepted(text):  # one document at a time, chains of their own
        x, weight, n = quality.line_features(pa.array([text], pa.string()))
        return model.documents(quality.share_of_good(model.lines(x, n), weight, n))[0] >= quality.THRESHOLD

    want = [(i, t) for i, t in rows if accepted(t)]
    counts = [len(rows), len(want)]
    for step in (brute_lines, brute_near, lambda r: brute_clean_of(r, [b["text"] for b in spark.read.parquet(
            f"{SF}/benchmark.parquet").collect()])):
        want = step(want)
        counts.append(len(want))
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[4] > counts[0] // 2, counts

    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces, held = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(pieces) == [i for i, _ in want]
    for i, t in want:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in held.values():  # gapless, and never over the window
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.fixture(scope="module")
def awkward(spark):
    long_line = " ".join(f"w{k}" for k in range(40))
    rows = [(1, None), (2, ""), (3, "one"), (4, "  \n\n \t"), (5, "é" * 300), (6, "word " * 5000), (None, "null id text"),
            (None, None), (7, "same row of words here"), (7, "same row of words here"), (8, "\x00 nul   sep"), (9, "x" * 20000),
            (10, long_line), (11, long_line), (11, "another text of the same id")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 5 else "s", None if t is None else len(t), *OWN)
                                  for i, t in rows], DOC)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_rows_of_awkward_tables(spark, awkward, name, stage):
    out = stage(spark, awkward, SF)
    assert out.schema.simpleString() == awkward.schema.simpleString()
    got = out.collect()
    assert all(tuple(r)[5:] == OWN for r in got)  # columns named like the stage's own keep their values
    texts = defaultdict(int)
    for r in awkward.collect():
        texts[r["doc_id"], r["text"]] += 1
    if name in ("near_dedup", "decontamination"):
        here = defaultdict(int)
        for r in got:
            here[r["doc_id"], r["text"]] += 1
        assert all(here[k] in (0, n) for k, n in texts.items())  # repeated rows go or stay together
        gone = {k for k, n in texts.items() if not here[k]}
        assert gone == ({(11, " ".join(f"w{k}" for k in range(40))), (11, "another text of the same id")} if name == "near_dedup" else set())
    assert stage(spark, awkward.limit(0), SF).collect() == []


def test_packing_stage_of_awkward_tables(spark, awkward):
    got = corpus_pipeline.pack(spark, awkward, SF).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (1, 2)) == 2  # the end id alone
    assert len([r for r in got if r["doc_id"] == 7]) == 2
    assert corpus_pipeline.pack(spark, awkward.limit(0), SF).collect() == []
