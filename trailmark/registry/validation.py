"""Registered validation queries (V01-V10, P21, P22) and their oracles.

JSON documents are rendered from the ``events`` rows by a fixed rule that
plants one kind of violation per field; the oracles compute the expected
violations from the same rule, independently of any JSON engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import validate as V
from trailmark.registry.io import LINES, _field, _schema_key, enriched_lines
from trailmark.registry.oracle_base import base_ctes, with_ctes
from trailmark.session import materialize
from trailmark.sources import tsv
from trailmark.sources.tables import atomic, read_table, spread

ATOMIC = base_ctes()[:2]

DOC_SCHEMA = {
    "type": "object",
    "required": ["clickId", "targetUrl"],
    "additionalProperties": False,
    "properties": {
        "clickId": {"type": "string"},
        "targetUrl": {"type": "string"},
        "lang": {"type": "string", "maxLength": 10, "minLength": 1},
        "tags": {"type": "array", "maxItems": 5, "minItems": 1},
        "lat": {"type": "number", "maximum": 90, "minimum": -90},
        "qty": {"type": "integer", "multipleOf": 5},
        "email": {"type": "string", "format": "email"},
        "kind": {"enum": ["view", "click", "purchase"]},
        "meta": {"type": "object", "maxProperties": 2, "minProperties": 1},
        "code": {"type": "string", "pattern": "^[A-Z]{2}[0-9]+$"},
        "id": {"type": "string", "format": "uuid"},
        "carrier": {"type": ["string", "null"]},
        "variant": {"oneOf": [{"type": "integer"}, {"type": "string", "maxLength": 3}]},
        "attrs": {"type": "object", "patternProperties": {"^x_": {"type": "string"}}},
    },
}


def documents(spark, sf) -> DataFrame:
    """One JSON document per event (id, doc)."""
    e = spread(read_table(spark, sf, "events"))
    n = F.col("event_id")
    s = lambda c: c.cast("string")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    tags = F.array_join(F.array_repeat(F.lit('"t"'), (n % 8).cast("int")), ",")
    meta = F.array_join(F.transform(F.array_repeat(F.lit(1), (n % 4).cast("int")),
                                    lambda x, i: F.concat(F.lit('"m'), s(i), F.lit('":1'))), ",")
    doc = F.concat(
        F.lit('{"clickId":'), F.when(n % 5 == 0, s(n)).otherwise(q(F.concat(F.lit("c"), s(n)))),
        F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(',"targetUrl":"https://x.example/'), s(n), F.lit('"'))),
        F.lit(',"lang":'), q(F.repeat(F.lit("x"), (n % 12).cast("int"))),
        F.lit(',"tags":['), tags, F.lit("]"),
        F.lit(',"lat":'), s(F.round((F.col("value") - 245) / 2.5, 2)),
        F.lit(',"qty":'), s(n % 17),
        F.lit(',"email":'), q(F.when(n % 6 == 0, F.lit("bad-email")).otherwise(F.concat(F.lit("u"), s(n), F.lit("@example.com")))),
        F.lit(',"kind":'), q(F.col("event_type")),
        F.when(n % 9 == 0, F.lit(',"extra":true')).otherwise(F.lit("")),
        F.lit(',"meta":{'), meta, F.lit("}"),
        F.lit(',"code":'), q(F.when(n % 11 == 0, F.lit("bad code!")).otherwise(F.concat(F.lit("AB"), s(n % 100)))),
        F.lit(',"id":'), q(F.when(n % 13 == 0, F.lit("123")).otherwise(
            F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(s(n), 12, "0")))),
        F.lit(',"carrier":'), F.when(n % 10 == 0, F.lit("6")).when(n % 10 == 1, F.lit("null"))
        .otherwise(q(F.concat(F.lit("carrier"), s(n % 4)))),
        F.lit(',"variant":'), F.when(n % 3 == 0, s(n)).when(n % 3 == 1, F.lit('"ab"')).otherwise(F.lit('"abcdef"')),
        F.lit(',"attrs":{"x_'), s(n % 3), F.lit('":'), F.when(n % 2 == 0, s(n)).otherwise(F.lit('"s"')), F.lit(',"y":1}'),
        F.lit("}"))
    return e.select(n.alias("id"), doc.alias("doc"))


_VIOLATIONS: dict = {}


def violations(spark, sf) -> DataFrame:
    """All violations (id, path, keyword), validated once per session and input.

    Validation reads stored documents, as it would a table of raw payloads;
    the per-keyword queries filter this one written result.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VIOLATIONS:
        docs = materialize(documents(spark, sf), "documents_json")
        _VIOLATIONS[key] = V.violation_rows(docs, "doc", DOC_SCHEMA, ["id"])
    return _VIOLATIONS[key]


# keyword query -> (path, keyword, SQL rule over events.event_id n / value / event_type)
KEYWORD_RULES = {
    "validate_type": ("$.clickId", "type", "n % 5 = 0"),
    "validate_union_type": ("$.carrier", "type", "n % 10 = 0"),
    "validate_required": ("$.targetUrl", "required", "n % 7 = 0"),
    "validate_additionalProperties": ("$", "additionalProperties", "n % 9 = 0"),
    "validate_enum": ("$.kind", "enum", "event_type NOT IN ('view', 'click', 'purchase')"),
    "validate_format": ("$.email", "format", "n % 6 = 0"),
    "validate_format_uuid": ("$.id", "format", "n % 13 = 0"),
    "validate_maximum": ("$.lat", "maximum", "round((value - 245) / 2.5, 2) > 90"),
    "validate_minimum": ("$.lat", "minimum", "round((value - 245) / 2.5, 2) < -90"),
    "validate_maxItems": ("$.tags", "maxItems", "n % 8 > 5"),
    "validate_minItems": ("$.tags", "minItems", "n % 8 = 0"),
    "validate_maxLength": ("$.lang", "maxLength", "n % 12 > 10"),
    "validate_minLength": ("$.lang", "minLength", "n % 12 = 0"),
    "validate_maxProperties": ("$.meta", "maxProperties", "n % 4 > 2"),
    "validate_minProperties": ("$.meta", "minProperties", "n % 4 = 0"),
    "validate_multipleOf": ("$.qty", "multipleOf", "(n % 17) % 5 <> 0"),
    "validate_oneOf": ("$.variant", "oneOf", "n % 3 = 2"),
    "validate_pattern": ("$.code", "pattern", "n % 11 = 0"),
    "validate_patternProperties": ("$.attrs", "patternProperties", "n % 2 = 0"),
}


def _kw_query(path, kw):
    return lambda s, sf: violations(s, sf).filter((F.col("path") == path) & (F.col("keyword") == kw))


def _kw_sql(path, kw, rule):
    return f"SELECT event_id AS id, '{path}' AS path, '{kw}' AS keyword FROM (SELECT *, event_id AS n FROM events) WHERE {rule}"


LIMITS = {"useragent": 30, "page_url": 29, "mkt_clickid": 100000}


def _props_errors(spark, sf):
    return V.validate_json(read_table(spark, sf, "events"), "props", {"properties": {"k": {"maximum": 50}}})


def q_incomplete_predicate(s, sf):
    """Good and incomplete events in one table; the predicate keeps those that hold a failure entity."""
    outputs = V.split_good_bad_incomplete(_props_errors(s, sf))
    both = outputs["good"].unionByName(outputs["incomplete"], allowMissingColumns=True)
    return both.filter(F.col("derived_contexts_failures").isNotNull()).select("event_id")


def q_split(s, sf):
    outs = V.split_good_bad_incomplete(_props_errors(s, sf))
    return outs["good"].select("event_id", F.lit("good").alias("output")).unionByName(
        outs["bad"].select("event_id", F.lit("bad").alias("output"))).unionByName(
        outs["incomplete"].select("event_id", F.lit("incomplete").alias("output")))


def _keys(s, sf):
    return atomic(s, sf).withColumn("schema", _schema_key())


def q_missing_schema(s, sf):
    a = _keys(s, sf)
    catalog = a.filter(F.col("event_name") != "transaction").select(F.col("schema").alias("schema_key")).distinct()
    return V.missing_schema_policy(a, catalog).select("event_id", "output")


REPOS = [("central", 10, []), ("acme-mirror", 5, ["com.acme"]), ("fallback", 1, ["org.other"])]


def q_resolve(s, sf):
    keys = _keys(s, sf).select(F.col("schema").alias("schema_key")).distinct()
    catalog = keys.select("schema_key", F.lit("central").alias("repository")).unionByName(
        keys.filter(F.col("schema_key").contains("/1-0-")).select("schema_key", F.lit("acme-mirror").alias("repository"))
    ).unionByName(keys.filter(F.col("schema_key").contains("/1-1-")).select("schema_key", F.lit("fallback").alias("repository")))
    repos = s.createDataFrame(REPOS, "repository string, priority int, vendor_prefixes array<string>")
    return V.resolve_schema(keys, catalog, repos).select("schema_key", "repository")


def q_upsert(s, sf):
    keys = _keys(s, sf).select(F.col("schema").alias("schema_key")).distinct()
    existing = keys.withColumn("body", F.lit("v1"))
    published = keys.filter(F.col("schema_key").endswith("-1")).withColumn("body", F.lit("v2"))
    return V.upsert_schema_catalog(existing, published, allow_patches=True)


QUERIES = {k: _kw_query(p, kw) for k, (p, kw, _) in KEYWORD_RULES.items()}
def q_atomic_field(s, sf):
    """Atomic-field failure: a true timestamp before the epoch (planted every 17th event)."""
    from trailmark.functions.timeutil import epoch_micros
    a = atomic(s, sf)
    n = F.substring(F.col("event_id"), 2, 20).cast("bigint")
    ms = F.when(n % 17 == 0, F.lit(-1)).otherwise((epoch_micros(F.col("derived_tstamp")) / 1000).cast("bigint"))
    return a.withColumn("true_tstamp_ms", ms).filter(F.col("true_tstamp_ms") < 0).select(
        "event_id", F.lit("true_tstamp").alias("path"), F.lit("minimum").alias("keyword"))


QUERIES.update({
    "validate_atomic_field": q_atomic_field,
    "validate_json": violations,
    "validate_multiple_failures": lambda s, sf: violations(s, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n_errors")),
    "size_violation": lambda s, sf: V.size_violation(read_table(s, sf, "documents"), "text", 10000)
        .select("doc_id", "payload_bytes", "failure"),
    "atomic_length_limits": lambda s, sf: (lambda a: a.select("event_id", V.length_errors(LIMITS, a.columns)
                                                             .alias("errors")))(atomic(s, sf)),
    "reject_or_accept_invalid": lambda s, sf: (lambda a: a.withColumn(
        "__bad", V.length_errors(LIMITS, a.columns) != ""))(atomic(s, sf)).select(
        "event_id", V.route_invalid(None, F.col("__bad"), False).alias("output_strict"),
        V.route_invalid(None, F.col("__bad"), True).alias("output_lenient")),
    "querystring_error": lambda s, sf: read_table(s, sf, "pages").withColumn(
        "q", F.regexp_extract("url", r"\?([^#]*)", 1)).filter(V.querystring_invalid(F.col("q")))
        .select("page_id", "q", F.lit("generic_error").alias("failure")),
    "querystring_error_planted": lambda s, sf: read_table(s, sf, "pages").withColumn(
        "q", F.concat(F.regexp_extract("url", r"\?([^#]*)", 1), F.when(F.col("page_id") % 5 == 0, F.lit("&x=%zz"))
                      .when(F.col("page_id") % 5 == 1, F.lit("&y=a b")).when(F.col("page_id") % 5 == 2, F.lit("&z=%4"))
                      .otherwise(F.lit("&w=%41")))).filter(V.querystring_invalid(F.col("q")))
        .select("page_id", "q", F.lit("generic_error").alias("failure")),
    "failure_entity": lambda s, sf: V.split_good_bad_incomplete(_props_errors(s, sf))["incomplete"].select(
        "event_id", F.col("derived_contexts_failures")[0]["schema"].alias("failure_schema"),
        F.size(F.col("derived_contexts_failures")[0]["data"]["errors"]).alias("n_errors")),
    "split_good_bad_incomplete": q_split,
    "missing_schema_policy": q_missing_schema,
    "resolve_schema": q_resolve,
    "upsert_schema_catalog": q_upsert,
    "incomplete_predicate": q_incomplete_predicate,
    "like_schema_filter": lambda s, sf: tsv.route_by_stream(enriched_lines(s, sf))
        .filter(F.col("schema").like("%good%")).select("event_id", "schema"),
})

_ALL = " UNION ALL ".join(_kw_sql(p, kw, r) for p, kw, r in KEYWORD_RULES.values())
PROPS_BAD = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50"
SKEY = ("'iglu:com.acme/' || event_name || '/jsonschema/1-' || CAST(CAST(substr(event_id, 2) AS BIGINT) % 3 AS VARCHAR) "
        "|| '-' || CAST(CAST(substr(event_id, 2) AS BIGINT) % 2 AS VARCHAR)")

ORACLE = {k: _kw_sql(p, kw, r) for k, (p, kw, r) in KEYWORD_RULES.items()}
ORACLE.update({
    "validate_json": _ALL,
    "validate_multiple_failures": f"SELECT id, count(*) AS n_errors FROM ({_ALL}) GROUP BY id",
    "size_violation": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS payload_bytes, 'size_violation' AS failure "
                      "FROM documents WHERE strlen(text) > 10000",
    "atomic_length_limits": with_ctes(ATOMIC, "SELECT event_id, concat_ws(',', CASE WHEN length(useragent) > 30 THEN 'useragent' END, "
                                              "CASE WHEN length(page_url) > 29 THEN 'page_url' END) AS errors FROM atomic"),
    "reject_or_accept_invalid": with_ctes(ATOMIC, "SELECT event_id, CASE WHEN coalesce(length(useragent) > 30, false) OR "
                                                  "coalesce(length(page_url) > 29, false) THEN 'bad' ELSE 'good' END AS output_strict, "
                                                  "'good' AS output_lenient FROM atomic"),
    "querystring_error": "SELECT page_id, q, 'generic_error' AS failure FROM (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS q "
                         "FROM pages) WHERE regexp_matches(q, '[ <>\"{}|\\\\^`]') OR regexp_matches(q, '%($|.$|[^0-9A-Fa-f]|.[^0-9A-Fa-f])')",
    "failure_entity": f"SELECT event_id, '{V.FAILURE_SCHEMA}' AS failure_schema, 1 AS n_errors FROM events WHERE {PROPS_BAD}",
    "split_good_bad_incomplete": f"SELECT event_id, 'good' AS output FROM events WHERE NOT ({PROPS_BAD}) UNION ALL "
                                 f"SELECT event_id, 'bad' FROM events WHERE {PROPS_BAD} UNION ALL "
                                 f"SELECT event_id, 'incomplete' FROM events WHERE {PROPS_BAD}",
    "missing_schema_policy": with_ctes(ATOMIC, "SELECT event_id, CASE WHEN event_name = 'transaction' THEN 'failed' ELSE 'good' END "
                                               "AS output FROM atomic"),
    "resolve_schema": with_ctes(ATOMIC, f"SELECT DISTINCT {SKEY} AS schema_key, CASE WHEN {SKEY} LIKE '%/1-0-%' THEN 'acme-mirror' "
                                        f"WHEN {SKEY} LIKE '%/1-1-%' THEN 'fallback' ELSE 'central' END AS repository FROM atomic"),
    "upsert_schema_catalog": with_ctes(ATOMIC, f"SELECT DISTINCT {SKEY} AS schema_key, CASE WHEN {SKEY} LIKE '%-1' THEN 'v2' "
                                               "ELSE 'v1' END AS body FROM atomic"),
    "incomplete_predicate": f"SELECT event_id FROM events WHERE {PROPS_BAD}",
    "validate_atomic_field": with_ctes(ATOMIC, "SELECT event_id, 'true_tstamp' AS path, 'minimum' AS keyword FROM atomic "
                                               "WHERE CAST(substr(event_id, 2) AS BIGINT) % 17 = 0"),
    "querystring_error_planted": "SELECT page_id, q, 'generic_error' AS failure FROM (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) "
                                 "|| CASE page_id % 5 WHEN 0 THEN '&x=%zz' WHEN 1 THEN '&y=a b' WHEN 2 THEN '&z=%4' ELSE '&w=%41' END AS q "
                                 "FROM pages) WHERE page_id % 5 IN (0, 1, 2)",
    "like_schema_filter": with_ctes(LINES, f"SELECT {_field('event_id')} AS event_id, 'iglu:io.snowplow/good/jsonschema/1-0-0' AS schema "
                                           "FROM lines WHERE stream = 'enriched-good'"),
})
