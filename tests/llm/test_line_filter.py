"""Findings of round three: candidates of long lines, memory of workers."""

import random

import pyarrow as pa

from trailmark.llm import lines
from trailmark.llm.common import giving_back


def test_long_lines_with_a_shared_word_are_no_candidates_but_near_copies_are(spark):
    pick = random.Random(5)
    line = lambda: ["".join(pick.choices("abcdefghij", k=7)) for _ in range(150)]
    rows = [(i, " ".join(["shared", *line()])) for i in range(60)]
    near = line()
    rows += [(100 + i, " ".join([*near[:140], *line()[:10 + i]])) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = lines.class_table(lines.classed(docs))
    assert lines.candidates(classes).count() == 3  # 64 bits of parity let about half of the 1,770 random pairs pass
    got = {r["doc_id"]: (r["n_links"], r["n_removed"]) for r in lines.by_document(docs).collect()}
    assert got == {**{i: (0, 0) for i in range(60)}, 100: (2, 0), 101: (2, 1), 102: (2, 1)}


def test_a_worker_gives_back_memory_after_its_last_batch():
    seen = []

    def run(batches):
        for b in batches:
            yield b
        seen.append("end")

    batches = [pa.record_batch({"x": [1]}), pa.record_batch({"x": [2]})]
    assert list(giving_back(run)(iter(batches))) == batches and seen == ["end"]
