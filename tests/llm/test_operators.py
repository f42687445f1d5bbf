"""The training-data operators against brute force, round trips and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trailmark.llm import (decontamination, graph, html, language, lines, minhash, packing, passages, quality,
                           suffixes, syncmers)

DOC = "doc_id long, text string, source string, text_2 string"
AWKWARD = [(1, None), (2, ""), (3, "one"), (4, "  \n\n \t"), (5, "é" * 300), (6, "word " * 5000), (None, "null id text"),
           (7, "same row"), (7, "same row"), (8, "\x00 nul   sep"), (9, "x" * 20000)]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(5, 200))) for _ in range(60)]
    passage = " ".join(words(rng, 70))
    out = []
    for i, t in enumerate(texts):
        if i % 7 == 3:
            t = texts[i - 3]  # exact copies
        elif i % 7 == 5:
            near = texts[i - 5].split()
            near[len(near) // 2] = "changed"
            t = " ".join(near)
        elif i % 7 == 6:
            t = t + "\n" + passage + "\n" + texts[(i * 3) % 60][:40]
        out.append((i * 3, t))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOC)


def test_contamination_against_brute_force(spark, corpus):
    items = [(0, " ".join(corpus[4][1].split()[2:30])), (1, "w1 w2"), (2, corpus[13][1][-200:]), (3, None), (3, ""),
             (None, " ".join(corpus[8][1].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = corpus + AWKWARD
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    want = []
    for i, t in rows:
        w, hit, found = low(t), set(), set()
        for item, text in items:
            b = low(text)
            n = min(10, len(b))
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    for block in (1 << 20, 40):  # one block, and several passes
        got = decontamination.contamination(frame(spark, rows), bench, block_bytes=block).collect()
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]))) for r in got)
    best = decontamination.longest_matches(frame(spark, corpus), bench).filter("item_id = '0' AND item_pos = 0").first()
    assert best["n_words"] == 28


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (50, 1), (400, 2), (3000, 4)):
        text = rng.integers(97, 97 + k, n).astype(np.uint8)
        raw = text.tobytes()
        sa = suffixes.suffix_array(text, 50)
        assert sorted(sa.tolist()) == list(range(n))
        keys = [raw[i:i + 50] for i in sa]
        assert keys == sorted(keys)


def test_suffix_dedup_against_brute_force(spark, corpus):
    rows = corpus + AWKWARD
    first = {}
    place = lambda i: -1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], 10 ** 9), place(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < place(i):
                gone.update(range(k, k + 50))
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        want.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.removed(frame(spark, rows), chunk_bytes=4096, key_parts=3, parts=4).collect()
    assert sorted(map(repr, want)) == sorted(repr((
        r["doc_id"], r["n_bytes"], sum(s["length"] for s in r["spans"]), len(r["spans"]),
        hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in got)


def test_near_duplicates_against_brute_force(spark, corpus):
    rows = corpus + AWKWARD

    def sets(t, width):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    for width in (2, 5):
        parent = {i: i for i, _ in rows if i is not None}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        s = [(i, sets(t, width)) for i, t in rows if i is not None]
        for a, (i, x) in enumerate(s):
            for j, y in s[:a]:
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
        got = minhash.near_duplicates(frame(spark, rows), width, 80, 100).filter("doc_id IS NOT NULL").collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, root(i)) for i in parent}
        assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(x)) for i, x in s)


def test_chain_of_near_copies_is_one_component(spark):
    """Neighbours are linked, the ends are not: the smallest class does not reach all of its cluster."""
    base = [f"a{k}" for k in range(101)]
    rows = []
    for i in range(12):
        t = list(base)
        for k in range(i):
            t[k * 8] = f"x{k}"
        rows.append((i, " ".join(t)))
    got = minhash.near_duplicates(frame(spark, rows), 2, 80, 100).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(50, 51), (5, 5)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(edges).collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, 50: 50, 51: 50}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    base = [words(rng, rng.randrange(1, 30), 60) for _ in range(60)]
    rows = []
    for i in range(30):
        ls = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = f"w{rng.randrange(60)}"
            ls.append(" ".join(line))
        rows.append((i, "\n".join(ls)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, rows[0][1])]
    every = [(i, k, set(x.split())) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    alike = lambda x, y: len(x | y) > 0 and 5 * len(x & y) >= 4 * len(x | y)
    want = {}
    for i, _ in rows:
        own = [(k, x) for j, k, x in every if j == i]
        gone = [k for k, x in own if any(alike(x, y) for j, m, y in every if (j, m) < (i, k))]
        links = sum(alike(x, y) for k, x in own for j, m, y in every if (j, m) != (i, k))
        want[i] = (len(own), gone, links)
    got = {r["doc_id"]: (r["n_lines"], r["removed"], r["n_links"]) for r in lines.by_document(frame(spark, rows)).collect()}
    assert got == want
    left = {r["doc_id"]: r["text"] for r in lines.clean(frame(spark, rows)).collect()}
    for i, t in rows:
        rest = [x for k, x in enumerate((t or "").split("\n")) if k not in want[i][1]]
        assert left.get(i, "") == ("" if t is None and left.get(i) == "" else (left.get(i) if t is None else "\n".join(rest))) or not rest


def test_pipeline_line_dedup_compares_short_lines(spark):
    """Against brute force without a least number of words; four words match five that hold them."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(words(rng, rng.randrange(0, 8), 6)) for _ in range(rng.randrange(1, 5))) or "w0")
            for i in range(30)]
    rows += [(40, "All rights reserved."), (41, "new line here\nAll rights reserved.\n\n日本語"), (42, "日本語\nreserved. All rights"),
             (43, "p q r s"), (44, "p q r s t\np q r")]
    alike = lambda x, y: x and y and 5 * len(x & y) >= 4 * len(x | y)
    before, want = [], {}
    for i, t in rows:
        rest, own, lost = [], [], False
        for line in t.split("\n"):
            x = set(line.split())
            gone = any(alike(x, y) for y in before + own)
            lost |= gone
            rest += [] if gone else [line]
            own.append(x)
        before += own
        if not lost or "\n".join(rest).strip(" "):
            want[i] = "\n".join(rest)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, frame(spark, rows), "").collect()}
    assert got == want
    assert 42 not in got and got[41] == "new line here\n\n日本語" and got[44] == "p q r"


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v = rng.permutation(np.arange(1, 61)).astype(np.uint64)
        v[rng.integers(0, 60, 2)] = 0
        want = set()
        for c in np.flatnonzero(v):
            a = z = int(c)
            while a > 0 and v[a - 1] > v[c]:
                a -= 1
            while z < 59 and v[z + 1] >= v[c]:
                z += 1
            if z - a + 1 >= 6:
                want.add((a, int(c), z))
        assert set(zip(*[x.tolist() for x in passages.compact_windows(v, 6)])) == want


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(9)
    clean = lambda n: words(rng, n, 100_000)
    passage = clean(80)
    near = list(passage)
    near[40] = "other"
    rows = [(i, " ".join(clean(120))) for i in range(20)]
    rows += [(20, " ".join(clean(50) + passage + clean(30))), (30, " ".join(clean(10) + passage)),
             (31, " ".join(clean(90) + near + clean(5)))]
    got = {r["doc_id"]: r for r in passages.repeated(frame(spark, rows + [r for r in AWKWARD if r[0] != 20])).collect()}
    assert [(s["start"], s["length"]) for s in got[30]["spans"]] == [(10, 80)]
    assert got[31]["spans"][0]["start"] == 90 and got[31]["n_removed"] >= 75
    assert all(got[i]["n_removed"] == 0 for i, _ in rows[:21])
    assert 20 in got[30]["sources"]


def test_a_passage_with_a_wide_insertion_is_verified_whole(spark):
    """46 words, 13 inserted ones and 46 more: 84 common of 105 shingles, each part too short by itself."""
    rng = random.Random(12)
    clean = lambda n: words(rng, n, 10 ** 9)
    rows, want = [], {}
    for i in range(10):
        one, two = clean(46), clean(46)
        rows += [(i, " ".join(clean(30) + one + two + clean(30))),
                 (100 + i, " ".join(clean(20) + one + clean(13) + two + clean(40)))]
        want[100 + i] = [(20, 105)]
    got = {r["doc_id"]: [(s["start"], s["length"]) for s in r["spans"]] for r in passages.repeated(frame(spark, rows)).collect()}
    assert got == {i: want.get(i, []) for i, _ in rows}


def test_best_fit_decreasing_matches_a_plain_search():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 65, 300)
    seq, offset = packing.best_fit_decreasing(sizes, 64)
    room = []
    for n in sorted(sizes.tolist(), reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(64 - n)
    assert seq.max() + 1 == len(room)
    for s in range(len(room)):
        at = np.flatnonzero(seq == s)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.cumsum(sizes[at]) - sizes[at]).all() and sizes[at].sum() <= 64


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = AWKWARD + [(100, "Don't STOP <|endoftext|> 12 naïve Straße 日本語 ﬁ İ é … $%a's"), (101, "many words " * 9000)]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    got = packing.packed(frame(spark, rows)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])) for r in got)
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(6)
    n_lines = np.array([3, 1, 4])
    state, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    _, good, _ = quality.marginals(state, trans, n_lines)
    at = 0
    for n in n_lines:
        total, mass = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(state[at + k, y[k]] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            mass += p * np.array(y)
        assert np.allclose(good[at:at + n], mass / total)
        at += n


def test_quality_learns_and_scores_awkward_rows(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(120):
        bad = i % 3 == 0
        line = lambda: " ".join(w.upper() + "!!" if bad else w for w in words(rng, 12))
        docs.append((i, "\n".join(line() for _ in range(rng.randrange(1, 5)))))
        labels.append((i, 0 if bad else 1))
    model = quality.learn(frame(spark, docs[:90]), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(frame(spark, docs[90:] + AWKWARD), model)
    assert got.columns[:4] == ["doc_id", "text", "source", "text_2"] and got.count() == 30 + len(AWKWARD)
    pred = {r["doc_id"]: r["predicted"] for r in got.collect()}
    assert all(pred[i] == y for i, y in labels[90:])
    none = quality.learn(frame(spark, docs[:5]), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(frame(spark, AWKWARD), none).collect()} == {0.5}


def test_language_profiles(spark):
    rng = random.Random(1)
    kinds = {"aa": ["banana", "ananas", "nabana"], "bb": ["tschuss", "schloss", "strumpf"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(20)), k, "x") for i, k in enumerate(["aa", "bb"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = language.learn(docs.filter("doc_id < 30"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, profiles).collect()}
    assert all(got[i] == k for i, _, k, _ in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "banana")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(odd, profiles).orderBy("doc_id").collect()] == ["und"] * 3 + ["aa"]
    assert language.identify(odd, {}).filter("lang_pred <> 'und'").isEmpty()


def test_syncmer_fingerprints(spark, corpus):
    got = {r["doc_id"]: r for r in syncmers.compared(frame(spark, corpus)).collect()}
    order = sorted(corpus)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        n = len(t)
        edited = t[:n - n // 2] + nxt[:n // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == n
    by_text = {}
    for i, t in corpus:
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    odd = syncmers.compared(frame(spark, AWKWARD))
    assert odd.count() == len(AWKWARD)
    one = syncmers.compared(frame(spark, [(1, "a b c")])).first()
    assert one["near_next"] == 1.0 and len(one["fingerprint"]) == 8
    assert syncmers.compared(frame(spark, [])).isEmpty()


PAGE = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><header>Site</header>
<nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more {0}</h1></header><p>First <b>bold</b>&nbsp;text<br>here<p>Second {0}
<form>Name <input></form><div class="share">Share</div><section id="comments"><p>Nice!</p></section></article>
<div class="box">Ever the same</div><aside>Side</aside><footer>&copy; 2024</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"https://Host.example:80/p{i}", PAGE.replace("{0}", f"page {i}")) for i in range(6)]
    rows += [(10, None, None), (11, "x", ""), (12, "https://other/", "<p>a<p>b <i>c</i> &lt;d&gt;"), (12, "https://other/", "<p>a")]
    rows += [(20 + i, "http://plain.example/", f"<body><div>Words {i} of the page</div><table><tr><td>Furniture</table></body>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in html.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[0] == ["Title & more page 0\n\nFirst bold text here\n\nSecond page 0"]
    assert got[10] == [""] and got[11] == [""] and sorted(got[12]) == ["a", "a\n\nb c <d>"]
    assert got[21] == ["Words 1 of the page"]  # the branch that all pages share is gone


def test_html_names_are_evidence_only(spark):
    """Names never cost a page its article or most of its text; what all pages share goes by the tree."""
    menu, foot = "<nav>Home News</nav>", "<footer>&copy; 2024</footer>"
    body = lambda i: f"<h1>Title {i}</h1><p>Text {i} of the page goes on for some words.</p>"
    main = lambda i: f"Title {i}\n\nText {i} of the page goes on for some words."
    shapes = {
        "sidebar": lambda i: f"<div class='with-sidebar'>{menu}<article>{body(i)}</article></div>{foot}",
        "widget": lambda i: f"{menu}<div class='elementor-widget'><article>{body(i)}</article></div>{foot}",
        "form": lambda i: f"<form>{menu}<div id='content'>{body(i)}</div>{foot}</form>",
        "hidden": lambda i: f"<div style='visibility:hidden'>{menu}<main>{body(i)}</main></div>",
        "teaser": lambda i: f"{menu}<div id='content'>{body(i)}</div><aside><article>Teaser {i}</article></aside>{foot}",
        "advert": lambda i: f"{menu}<article>{body(i)}</article><div class='ad'>Buy {i} now</div>{foot}",
        "plain": lambda i: f"<div class='top'>Home News</div><article>{body(i)}<div>Thank you for reading</div></article>"}
    rows = [(100 * k + i, f"https://{name}.example/{i}", f"<html><body>{f(i)}</body></html>")
            for k, (name, f) in enumerate(shapes.items()) for i in range(5)]
    # a single page of its host, and a teaser article beside the main text
    rows += [(1000 + k, f"https://one-{name}.example/", f(0)) for k, (name, f) in enumerate(shapes.items()) if name != "plain"]
    rows += [(2000, "https://alone.example/", f"<article>Teaser</article><div id='content'>{body(0)}</div>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in got if i < 1000} == {i: main(i % 100) for i, _, _ in rows if i < 1000}
    assert {i: got[i] for i in got if 1000 <= i < 2000} == {i: main(0) for i, _, _ in rows if 1000 <= i < 2000}
    assert got[2000] == "Teaser\n\n" + main(0)


def test_html_furniture_does_not_depend_on_the_hosts_size(spark):
    """A notice that reads the same on 6 of 126 pages of a host goes as on a host with no others."""
    text = lambda i: f"Text {i} of the page goes on"
    rows = [(i, f"https://{h}.example/{i}", f"<div class='t'><div>{text(i)}</div><div class='x'>Home News</div></div>")
            for h, k in (("large", 0), ("small", 1000)) for i in range(k, k + 6)]
    rows += [(i, f"https://large.example/{i}", f"<p>{text(i)}</p>") for i in range(100, 220)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text(i) for i, _, _ in rows}


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert decontamination.contamination(none, bench).isEmpty()
    assert quality.score(none, quality.learn(none, labels)).isEmpty()
    for f in (minhash.near_duplicates, suffixes.removed, lines.by_document, passages.repeated, packing.packed):
        assert f(none).isEmpty()
    assert language.learn(none.withColumnRenamed("source", "lang")) == {}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_awkward_rows_everywhere(spark):
    docs = frame(spark, AWKWARD)
    for f in (minhash.near_duplicates, suffixes.removed, passages.repeated):
        assert f(docs).count() == len(AWKWARD)
    assert lines.clean(docs).columns == docs.columns


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, sf)
        assert out.columns == docs.columns
        seen.append(out.count())
        step = out
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * docs.count()
