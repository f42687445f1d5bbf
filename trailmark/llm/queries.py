"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.llm import (decontamination, html, language, lines, manifest, minhash, packing, passages, quality, search,
                           suffixes, syncmers, toxicity)
from trailmark.llm.common import crc_mod, load

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def op1_decontamination(spark, sf_dir):
    found = decontamination.contamination(load(spark, sf_dir, "documents").select("doc_id", "text"),
                                          load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_quality(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = quality.learn(docs.filter(~held_out), load(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted",
                                             F.size("bad_lines").alias("n_bad_lines"))


def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(load(spark, sf_dir, "documents"), width=2, num=80, den=100)


def op4_suffix_dedup(spark, sf_dir):
    found = suffixes.removed(load(spark, sf_dir, "documents"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return found.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op5_html(spark, sf_dir):
    return html.extract(load(spark, sf_dir, "pages"))


def op6_line_dedup(spark, sf_dir):
    return lines.by_document(load(spark, sf_dir, "documents")).drop("row")


def op7_passages(spark, sf_dir):
    return passages.repeated(load(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    profiles = language.learn(docs.filter(~held_out))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles, keep=("held_out",))


def op9_syncmers(spark, sf_dir):
    return syncmers.compared(load(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.packed(load(spark, sf_dir, "documents"))


def op11_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    model = toxicity.learn(docs.filter(~held_out), load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_manifest(spark, sf_dir):
    return manifest.manifest(load(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position")


def op13_search(spark, sf_dir):
    return search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_quality, op3_minhash, op4_suffix_dedup, op5_html, op6_line_dedup, op7_passages,
    op8_language, op9_syncmers, op10_packing, op11_toxicity, op12_manifest,
    op13_search)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item FROM occ o JOIN win ON win.n = o.n AND win.s = o.s),
words AS (SELECT doc_id, count(*) AS n_hit
          FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit))
          GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 - 49 AS BIGINT))) AS p FROM d WHERE length(h) >= 100)),
least_doc AS (SELECT s, min(doc_id) AS m FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT w.doc_id, w.p FROM w JOIN least_doc l ON w.s = l.s AND l.m < w.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM starts),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
         FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY 1),
kept AS (
  SELECT b.doc_id, sha256(unhex(string_agg(b.x, '' ORDER BY b.p))) AS sha
  FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS x
        FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT))) AS p FROM d)) b
  LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept.sha, '{EMPTY_SHA}') AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, i - 1 AS line_no, list_sort(list_distinct(list_filter(
           string_split_regex(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d))),
k AS (SELECT w, len(w) AS n, row_number() OVER () AS k, min((doc_id, line_no)) AS f, count(*) AS c
      FROM l WHERE len(w) >= 1 GROUP BY w),
t AS (SELECT k, n, unnest(w) AS x FROM k),
p AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.x = b.x AND a.k <> b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
      GROUP BY a.k, b.k, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
m AS (SELECT p.a AS k, min(k.f) AS f, sum(k.c) AS c FROM p JOIN k ON k.k = p.b GROUP BY 1),
full_k AS (SELECT k.w, least(k.f, coalesce(m.f, k.f)) AS f, k.c - 1 + coalesce(m.c, 0) AS links
           FROM k LEFT JOIN m USING (k)),
j AS (SELECT l.r, l.doc_id, l.line_no, coalesce(full_k.links, 0) AS links,
             coalesce(full_k.f < (l.doc_id, l.line_no), false) AS removed, full_k.f[1] AS source
      FROM l LEFT JOIN full_k ON full_k.w = l.w)
SELECT d.doc_id,
       least(d.doc_id, coalesce(min(j.source) FILTER (WHERE j.removed), d.doc_id)) AS class_id,
       CAST(coalesce(sum(j.links), 0) AS BIGINT) AS n_links, CAST(count(j.line_no) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE j.removed) AS BIGINT) AS n_removed,
       coalesce(list(CAST(j.line_no AS INTEGER) ORDER BY j.line_no) FILTER (WHERE j.removed), []) AS removed
FROM d LEFT JOIN j USING (r) GROUP BY d.r, d.doc_id
"""

_S = syncmers
OP9_SQL = rf"""
WITH o AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id))
           AS next FROM documents),
e AS (SELECT doc_id, text, next, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2)
        AS edited FROM o),
v AS (SELECT doc_id, 'own' AS k, text AS t FROM e UNION ALL SELECT doc_id, 'new', edited FROM e
      UNION ALL SELECT doc_id, 'next', next FROM e),
c AS (SELECT doc_id, k, list_transform(regexp_extract_all(t, '{_S.LETTER}'),
               lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS c FROM v),
s AS (SELECT doc_id, k, c, len(c) AS n,
             list_transform(range(1, len(c)), lambda i: (c[i] * {_S.A} + c[i + 1] * {_S.B}) % {_S.MOD}) AS s FROM c),
a AS (SELECT doc_id, k, CASE
        WHEN n = 0 THEN CAST([] AS BIGINT[])
        WHEN n < {_S.K} THEN [list_reduce(c, lambda acc, x: (acc * {_S.A} + x * {_S.B}) % {_S.MOD}, CAST(n AS BIGINT))]
        ELSE list_transform(list_filter(range(1, n - {_S.K} + 2), lambda i:
               (s[i] <= s[i + 1] AND s[i] <= s[i + 2] AND s[i] <= s[i + 3])
               OR (s[i + 3] < s[i] AND s[i + 3] < s[i + 1] AND s[i + 3] < s[i + 2])),
             lambda i: (s[i] * {_S.C} + s[i + 2] * {_S.D} + s[i + 3] * {_S.E}) % {_S.MOD}) END AS a FROM s),
f AS (SELECT doc_id, k, list_distinct(a) AS u,
             array_to_string(list_transform(a, lambda x: lower(lpad(printf('%X', x), 8, '0'))), '') AS h FROM a),
r AS (SELECT own.doc_id, own.h AS fingerprint, new.h AS edited_fingerprint, own.u AS u, new.u AS nu, nx.u AS xu
      FROM f own JOIN f new ON new.doc_id = own.doc_id AND new.k = 'new'
      JOIN f nx ON nx.doc_id = own.doc_id AND nx.k = 'next' WHERE own.k = 'own')
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, r.fingerprint,
       r.edited_fingerprint,
       CASE WHEN len(u) + len(nu) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(u, nu)) / (len(u) + len(nu)) END AS near_edited,
       CASE WHEN len(u) + len(xu) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(u, xu)) / (len(u) + len(xu)) END AS near_next
FROM e JOIN r USING (doc_id)
"""



def _field(column: str) -> str:
    value = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _fold(level: str, run: str, up: str, n: int = 16) -> str:
    """A run table of a level, and the level above it."""
    return f"""{run} AS (SELECT g, p // {n} AS p, n, list(h ORDER BY p) AS l FROM {level} WHERE n > 1 GROUP BY g, p // {n}, n),
{up} AS (SELECT g, p, (n + {n - 1}) // {n} AS n, sha256(array_to_string(l, '')) AS h FROM {run}),"""


def _walk(before: str, run: str, after: str, n: int = 16) -> str:
    """Each leaf's folded node and siblings after one more level (unchanged where its group has one node left)."""
    return f"""{after} AS (
  SELECT w.k, w.g, w.p // {n} AS p,
         CASE WHEN r.l IS NULL THEN w.f ELSE sha256(array_to_string(r.l[:w.p % {n}] || [w.f] || r.l[w.p % {n} + 2:], '')) END AS f,
         CASE WHEN r.l IS NULL THEN w.s ELSE w.s || array_to_string(r.l[:w.p % {n}] || r.l[w.p % {n} + 2:], '') END AS s
  FROM {before} w LEFT JOIN {run} r ON r.g = w.g AND r.p = w.p // {n}),"""


LEVELS = 7  # of the SQL below: 16 ** 7 leaves a group, and as many groups
_LEAF = "sha256(" + " || ".join(map(_field, manifest.FIELDS)) + ")"
_LOW = "sha256(" + " || ".join(
    _field(f"translate(text, '{_UPPER}', '{_LOWER}')" if c == "text" else c) for c in manifest.FIELDS) + ")"
OP12_SQL = f"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v
    FROM range(256) r(i))),
d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS g, {_LEAF} AS leaf, {_LOW} AS low,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: x <> ''),
                            lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 5 = 0 AS altered
  FROM documents, crc),
a0 AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY coalesce(doc_id, -9223372036854775808), leaf, k) - 1 AS p,
              count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d),
{"".join(_fold(f"a{i}", f"r{i}", f"a{i + 1}") for i in range(LEVELS))}
tops AS ({" UNION ALL ".join(f"SELECT g, h FROM a{i} WHERE n = 1" for i in range(LEVELS + 1))}),
b0 AS (SELECT '' AS g, g AS of, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, h FROM tops),
{"".join(_fold(f"b{i}", f"q{i}", f"b{i + 1}") for i in range(LEVELS))}
root AS ({" UNION ALL ".join(f"SELECT h FROM b{i} WHERE n = 1" for i in range(LEVELS + 1))}),
w0 AS (SELECT d.k, d.g, a0.p, CASE WHEN altered THEN low ELSE leaf END AS f, '' AS s FROM d JOIN a0 USING (k)),
{"".join(_walk(f"w{i}", f"r{i}", f"w{i + 1}") for i in range(LEVELS))}
x0 AS (SELECT w.k, '' AS g, b0.p, w.f, w.s FROM w{LEVELS} w JOIN b0 ON b0.of = w.g),
{"".join(_walk(f"x{i}", f"q{i}", f"x{i + 1}") for i in range(LEVELS))}
z AS (SELECT * FROM x{LEVELS})
SELECT d.doc_id, d.leaf, tops.h AS subroot, root.h AS root, sha256(z.s) AS proof_sha256, z.f AS folded_root,
       z.f = root.h AS verified, CAST(a0.p AS BIGINT) AS position
FROM d JOIN a0 USING (k) JOIN tops ON tops.g = d.g JOIN z ON z.k = d.k CROSS JOIN root
"""

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT q, item_id, t, count(*) AS r FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT k, doc_id, n, t, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM p, s GROUP BY t),
i AS (SELECT k, doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))) AS v
      FROM p JOIN f USING (t), s),
x AS (SELECT q, item_id, k, doc_id, CAST(sum(r * v) AS BIGINT) AS score FROM qt JOIN i USING (t) GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, k) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM y WHERE rank <= 10
"""

ORACLE = {"op1_decontamination": OP1_SQL, "op3_minhash": OP3_SQL, "op4_suffix_dedup": OP4_SQL,
          "op6_line_dedup": OP6_SQL, "op9_syncmers": OP9_SQL,
          "op12_manifest": OP12_SQL, "op13_search": OP13_SQL}
