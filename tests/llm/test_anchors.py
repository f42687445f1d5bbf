"""Passages that a smaller document holds, but not the first holder of any of their shingles (op7_passages)."""

import random

import numpy as np

from trailmark.llm import anchors, packing, passages


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(rng, n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def test_a_passage_whose_first_holders_are_unlike_is_found(spark):
    """Pairs share 56 words, of which each stretch of 20 also stands in smaller documents and in one between the two."""
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(12):
        shared = words(rng, 56)
        for k, at in enumerate(range(0, 40, 4)):
            piece = shared[at:at + 20]
            rows.append((1000 * i + k, " ".join(words(rng, 60) + piece + words(rng, 60))))
            rows.append((1000 * i + 500 + k, " ".join(words(rng, 60) + piece + words(rng, 60))))
        rows.append((1000 * i + 100, " ".join(words(rng, 40) + shared + words(rng, 30))))
        rows.append((1000 * i + 900, " ".join(words(rng, 20) + shared + words(rng, 50))))
        want[1000 * i + 900] = ([(20, 56)], [1000 * i + 100])
    got = {r["doc_id"]: ([(s["start"], s["length"]) for s in r["spans"]], r["sources"])
           for r in passages.repeated(frame(spark, rows)).collect()}
    assert got == {i: want.get(i, ([], [])) for i, _ in rows}


def test_a_group_of_one_key_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(6)
    line = words(rng, 30)
    rows = [(i, " ".join(words(rng, 60) + line + words(rng, 60))) for i in range(60)]
    own = words(rng, 25)
    rows += [(100, " ".join(words(rng, 30) + line + own + words(rng, 20))),
             (200, " ".join(words(rng, 70) + line + own + words(rng, 5)))]

    def run():
        return {r["doc_id"]: [(s["start"], s["length"]) for s in r["spans"]]
                for r in passages.repeated(frame(spark, rows)).collect() if r["spans"]}

    assert run() == {200: [(70, 55)]}
    monkeypatch.setattr(anchors, "BLOCK", 7)
    assert run() == {200: [(70, 55)]}


def test_anchors_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(10):
        v = rng.permutation(np.arange(1, 81)).astype(np.uint64)
        cut = np.array([0, 30, 30, 37, 80])
        v[[29, 36, 79]] = 0
        want = np.zeros(80, bool)
        for a, z in zip(cut, cut[1:]):
            for s in range(a, z - 9):
                run = v[s:s + 10]
                if (run > 0).all():
                    want[s + np.argsort(run)[:4]] = True
        assert (anchors.places_of(v, v, cut, 10, 4) == want).all()


def test_one_tokenizer_serves_both_ways():
    """Plain and odd words in turn get the ids that the unchanged tokenizer gives the whole text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain, mine = Tokenizer.from_file(path), packing.Words(path)
    texts = ["One plain text, it's 42.", "“odd” — 日本語 <|x|> text", "plain again, naïve words"]
    for text in texts + texts:
        assert np.frombuffer(mine.ids(pa.array([text]))[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
