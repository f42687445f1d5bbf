"""Toxicity, manifest and search against brute force, held-out rows and awkward tables."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from trailmark.llm import manifest, queries, search, toxicity

AWKWARD = [(1, None), (2, ""), (3, "One two"), (4, "  \n\n \t"), (5, "é" * 300), (6, "word " * 5000), (None, "null id Text"),
           (None, None), (7, "same ROW"), (7, "same ROW"), (7, "other row"), (8, "\x00 nul   sep"), (9, "x" * 20000),
           (-2 ** 63, "least id"), (2 ** 63 - 1, "greatest id"), (-1, "same row one"), (64, "one"), (63, "two one")]


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def fold(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 16 * 16
        out.append((nodes[run:i], nodes[i + 1:run + 16]))
        i //= 16
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, h(map(field, r))))
    trees = {}
    for g, found in groups.items():
        found.sort(key=lambda x: (-2 ** 63 if x[0][0] is None else x[0][0], x[1]))
        trees[g] = fold([leaf for _, leaf in found])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = fold([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (r, leaf) in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            at = leaf
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0:
                at = h(map(field, (*r[:4], r[4] and r[4].translate(low))))
            for before, after in path:
                at = h([*before, at, *after])
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(x for p in path for side in p for x in side), at,
                        at == top[-1][0], i))
    return sorted(map(repr, out))


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string, position long"


@pytest.mark.parametrize("case", ["mixed", "one", "many", "sources"])
def test_manifest_against_brute_force(spark, case):
    rng = random.Random(3)
    if case == "mixed":
        rows = [(i, rng.choice([None, "", "a", "é", "="]), rng.choice([None, "en"]), n, t)
                for i, t in AWKWARD for n in (None, 3)]
    elif case == "one":
        rows = [(5, None, None, None, None)]
    elif case == "many":  # one source of several arrays (300 and one more), ids far apart, one id many times
        rows = [(rng.randrange(-10 ** 6, 10 ** 12) if k % 3 else k // 3, "hot" if k % 3 else "b", "en", k, f"Text {k % 500}")
                for k in range(900)] + [(7, "hot", "en", 1, f"T{k % 40}") for k in range(70)]
    else:  # more sources than an array holds
        rows = [(k, f"s{k % 311}", "en", 1, f"Text {k}") for k in range(700)]
    frame = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], DOCS)
    got = manifest.manifest(frame).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
                                          "position").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_manifest(rows)


def test_manifest_proofs_carry_siblings_and_empty_tables(spark):
    frame = spark.createDataFrame([(k, "s", "en", 1, f"t{k}", "", "", 1) for k in range(20)], DOCS)
    for r in manifest.proofs(frame, siblings=True).collect():
        assert sha256("".join(r["siblings"]).encode()).hexdigest() == r["proof_sha256"]
        assert [len(s) // 64 for s in r["siblings"]] == [15 if r["position"] < 16 else 3, 1]
        assert r["verified"]
    assert manifest.manifest(frame.limit(0)).collect() == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=10):
    words = lambda t: TERM.findall((t or "").translate(LOW))
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 25 + (75 * len(w) * n_docs) // total
            s = 0
            for t in words(text):
                tf = w.count(t)
                if tf:
                    df = sum(t in x for _, x in held)
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10 ** 9 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = list(AWKWARD)
    for k in range(150):
        vocabulary = 30 if k % 3 else 300
        out.append((k * 5, " ".join(f"W{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 9, 9, 9, 80])))))
    return out + [(1000 + k, "W1 w2 W3-w2 tie") for k in range(30)] + [(2000 + k, "tie w2") for k in range(30)]


def test_search_against_brute_force(spark, texts, monkeypatch):
    items = [(1, "w1 W2, w2 tie"), (2, "tie"), (3, None), (3, ""), (3, "no_such thing"), (None, "w5 w6 w7 word"),
             (4, "é" * 300 + " row row SAME"), (4, "w299"), (5, " ".join(f"w{k}" for k in range(300)))]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in texts], "doc_id long, text string, m long, score double")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    want = brute_search(texts, items)
    for slice_size, block in ((1 << 20, 1 << 20), (50, 1 << 20), (1 << 20, 20)):
        monkeypatch.setattr(search, "SLICE", slice_size)
        got = search.search(docs.repartition(3), bench, block_bytes=block).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
    assert search.search(docs.limit(0), bench).collect() == []
    assert search.search(docs, bench.limit(0)).collect() == []


def test_search_visits_strata_by_bound_and_loses_nothing():
    rng = np.random.default_rng(0)
    n, vocabulary = 400, 30
    m, ids = rng.integers(25, 40, n), rng.permutation(n).astype(np.int64)
    held = rng.integers(0, 12, n)
    term = np.concatenate([np.sort(rng.choice(vocabulary, k, replace=False)) for k in held]).astype(np.int32)
    tf = rng.integers(1, 6, len(term)).astype(np.int32)
    strata = search.Strata(ids, m, held, term, tf)
    doc = np.repeat(np.arange(n), held)
    for huge in (1, 10 ** 7):  # the second: sums beyond what a float holds
        terms, factor = np.array([1, 4, 9, 20]), np.array([700, 0, 90, 12345]) * huge
        want = np.zeros(n, dtype=object)
        for t, f in zip(terms, factor):
            at = np.flatnonzero(term == t)
            for p in at:
                want[doc[p]] += int(f) * (10 ** 9 * int(tf[p]) // (1000 * int(tf[p]) + 8 * int(m[doc[p]])))
        best = sorted(((-s, i) for s, i in zip(want, ids.tolist()) if s > 0))[:10]
        got = strata.search(terms, factor, np.zeros((0, 2), np.int64), 10)
        assert [(-s, i) for s, i in got.tolist()] == best


def test_toxicity_buckets_against_plain_counts():
    texts = ["The  quick\tBROWN fox", None, "", "ab", "aaaa aaaa aaaa", "é" * 40, "zero\0byte", "x" * 3000]
    doc, bucket, n = toxicity.buckets(texts)
    for i, t in enumerate(texts):
        plain = f" {' '.join((t or '').lower().replace(chr(0), ' ').split())} " if t else " "
        alone = toxicity.buckets([t])
        assert np.array_equal(bucket[doc == i], alone[1]) and np.array_equal(n[doc == i], alone[2])
        different = {plain[k:k + s] for s in toxicity.SIZES for k in range(len(plain) - s + 1)}
        assert n[doc == i].sum() == sum(max(0, len(plain) - s + 1) for s in toxicity.SIZES)
        assert len(alone[1]) == len(different)  # no two of these share a bucket


def test_toxicity_score_is_the_scaled_linear_form():
    """Scores against sums over dictionaries: tf times ratio times weight over the norm, then the curve."""
    rng = random.Random(1)
    label = np.arange(80) % 3 // 2
    texts = [" ".join(rng.choice(["good", "fine", "calm", *["vile", "rotten"][:2 * y]]) for _ in range(30)) for y in label]
    doc, bucket, n = toxicity.buckets(texts)
    counts = [np.bincount(bucket[label[doc] == k], n[label[doc] == k], minlength=1 << toxicity.BITS) for k in (0, 1)]
    ratio = toxicity.ratios(counts[1], counts[0])
    k = int(bucket[0])
    assert ratio[k] == pytest.approx(math.log((counts[1][k] + 1) / (counts[1] + 1).sum())
                                     - math.log((counts[0][k] + 1) / (counts[0] + 1).sum()))
    model = toxicity.fit(ratio, doc, bucket, n, label, np.arange(80) % 4 == 0)
    for t, s in zip(texts, model.scores(texts)):
        bag = dict(zip(*toxicity.buckets([t])[1:]))
        z = sum(c * model.weight[b] for b, c in bag.items()) / math.sqrt(sum(c * c for c in bag.values())) + model.bias
        assert s == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.a * z + model.b)))))
    assert np.mean((model.scores(texts) >= 0.7) == label) > 0.9


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op11_toxicity(spark, sf).collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(label[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in label]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01


def test_toxicity_of_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in AWKWARD], "doc_id long, text string, score string, label int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs, none) is None
    one_kind = spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.learn(docs, one_kind) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.5}
    both = spark.createDataFrame([(3, 1), (3, 0), (7, 0), (9, 0), (2, 0), (1, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, both)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1  # empty, blank and null alike
    assert len({r["score"] for r in got if r["text"] == "same ROW"}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_registered_queries_without_sql():
    import __spark_entry__ as e
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())
    assert (set(queries.QUERIES) | {"pipeline"}) - set(e.oracle_sql()) == {
        "op2_quality", "op5_html", "op7_passages", "op8_language", "op10_packing", "op11_toxicity", "pipeline"}


def test_line_dedup_gives_a_row_for_each_row(spark):
    """Rows that share an id, with one text or several: neither precedes the other, and each comes back."""
    from trailmark.llm import lines

    rows = [(1, "All rights reserved."), (2, "All rights reserved.\nnew line here"), (2, "All rights reserved.\nnew line here"),
            (2, "another text\nAll rights reserved."), (3, None), (3, None), (3, ""), (None, "another text"), (None, "another text"),
            (5, "new line here\nnew line here")]
    every = [(r, -1 if i is None else i, k, set(x.split())) for r, (i, t) in enumerate(rows) if t is not None
             for k, x in enumerate(t.split("\n"))]
    alike = lambda x, y: len(x | y) > 0 and 5 * len(x & y) >= 4 * len(x | y)
    want = []
    for r, (i, t) in enumerate(rows):
        own = [x for x in every if x[0] == r]
        gone = [k for _, j, k, x in own if any(alike(x, y) for _, a, m, y in every if (a, m) < (j, k))]
        links = sum(alike(x, y) for _, j, k, x in own for q, a, m, y in every if (q, m) != (r, k))
        want.append((i, len(own), len(gone), gone, links))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["removed"], r["n_links"]) for r in lines.by_document(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = sorted(map(repr, [tuple(r) for r in lines.clean(docs).collect()]))
    assert kept == sorted(map(repr, [(1, "All rights reserved."), (2, "new line here"), (2, "new line here"), (2, "another text"),
                                     (3, None), (3, None), (3, ""), (None, "another text"), (None, "another text")][:3]
                              + [(3, None), (3, None), (3, ""), (None, "another text"), (None, "another text")]))
