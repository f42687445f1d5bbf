"""Registered source/sink (S01-S17) and streaming (T01-T06) queries with their oracles.

Raw enriched TSV lines are rendered from the fixture by a fixed rule (NULL
-> '', a bad number every 10th event, bad JSON, ragged lines), split into
three origin streams by event number; file-based steps write under the
session's checkpoint folder and read the result back.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.contracts import ATOMIC_FIELDS, BOOL_FIELDS, JSON_FIELDS, NUMBER_FIELDS
from trailmark.session import checkpoint_dir
from trailmark.sources import lake, tsv
from trailmark.sources.dims import read_seed_csv
from trailmark.sources.tables import atomic, atomic_spread, read_table
from trailmark.streaming import late, start
from trailmark.streaming import pipeline as T
from trailmark.registry.oracle_base import base_ctes, with_ctes

ATOMIC = base_ctes()[:2]
POS = {n: i for i, n in enumerate(ATOMIC_FIELDS)}
BAD_SCHEMA = "iglu:com.snowplowanalytics.snowplow.badrows/schema_violations/jsonschema/2-0-0"
STREAM_OF = {0: "enriched-good", 1: "enriched-incomplete", 2: "enriched-bad"}
RAGGED_FIELDS = 40


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def _n():
    return F.substring(F.col("event_id"), 2, 20).cast("bigint")


def _line_fields() -> dict[str, object]:
    """field name -> Spark expression of its text (fields not listed are '')."""
    s = lambda c: F.col(c).cast("string")
    n = _n()
    return {
        "app_id": s("app_id"), "platform": s("platform"), "collector_tstamp": s("collector_tstamp"),
        "event": s("event_name"), "event_id": s("event_id"), "user_id": s("user_id"),
        "user_ipaddress": s("user_ipaddress"), "domain_userid": s("domain_userid"), "page_url": s("page_url"),
        "page_urlquery": s("page_urlquery"),
        "contexts": F.when(n % 4 == 0, F.lit('{"a":1}')).when(n % 4 == 1, F.lit("{bad")).otherwise(F.lit("")),
        "useragent": s("useragent"),
        "br_cookies": F.when(n % 3 == 0, F.lit("true")).when(n % 3 == 1, F.lit("false")).otherwise(F.lit("x")),
        "br_viewwidth": s("br_viewwidth"),
        "doc_width": F.when(n % 10 == 0, F.lit("abc")).otherwise(s("doc_width")),
        "tr_total_base": s("tr_total_base"), "domain_sessionid": s("domain_sessionid"),
        "derived_tstamp": s("derived_tstamp"),
    }


def _other_cell(name: str, i: int):
    """Text of a field that the fixture lacks, by its type: right and wrong numbers, booleans and JSON, empty text."""
    n = _n()
    if name in NUMBER_FIELDS:
        return F.when(n % 10 == i % 10, "abc").otherwise(((n + i) % 1000).cast("string"))
    if name in BOOL_FIELDS:
        return F.when((n + i) % 3 == 0, "true").when((n + i) % 3 == 1, "false").otherwise("x")
    if name in JSON_FIELDS:
        return F.when((n + i) % 4 == 0, '{"a":1}').when((n + i) % 4 == 1, "{bad").otherwise("")
    return F.when((n + i) % 5 == 0, "").otherwise(F.concat(F.lit(f"{name}-"), n.cast("string")))


def _other_sql(name: str, i: int) -> str:
    if name in NUMBER_FIELDS:
        return f"CASE WHEN {_N} % 10 = {i % 10} THEN 'abc' ELSE CAST(({_N} + {i}) % 1000 AS VARCHAR) END"
    if name in BOOL_FIELDS:
        return f"CASE ({_N} + {i}) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'x' END"
    if name in JSON_FIELDS:
        return f"CASE ({_N} + {i}) % 4 WHEN 0 THEN '{{\"a\":1}}' WHEN 1 THEN '{{bad' ELSE '' END"
    return f"CASE WHEN ({_N} + {i}) % 5 = 0 THEN '' ELSE '{name}-' || CAST({_N} AS VARCHAR) END"


def enriched_lines(spark, sf) -> DataFrame:
    """(origin stream, line) per fixture row; bad-stream rows are JSON bad-row documents."""
    a = atomic_spread(spark, sf)
    f = _line_fields()
    cells = [F.coalesce(f[name], F.lit("")) if name in f else _other_cell(name, i) for i, name in enumerate(ATOMIC_FIELDS)]
    n = _n()
    full = F.concat_ws("\t", *cells)
    ragged = F.concat_ws("\t", *cells[:RAGGED_FIELDS])
    line = F.when(n % 25 == 0, ragged).otherwise(full)
    bad = F.concat(F.lit('{"schema":"' + BAD_SCHEMA + '","data":{"payload":"'), F.col("event_id"), F.lit('"}}'))
    stream = F.when(n % 3 == 0, STREAM_OF[0]).when(n % 3 == 1, STREAM_OF[1]).otherwise(STREAM_OF[2])
    return a.select(stream.alias("stream"), F.when(n % 3 == 2, bad).otherwise(line).alias("value"))


def q_read_enriched_tsv(s, sf):
    lines = enriched_lines(s, sf).filter(F.col("stream") != "enriched-bad")
    return tsv.read_enriched_tsv(lines)


def q_union_tagged_streams(s, sf):
    lines = enriched_lines(s, sf)
    return tsv.union_tagged_streams({k: lines.filter(F.col("stream") == k) for k in STREAM_OF.values()})


def _json_texts(held) -> list:
    """Text of every field of a rendered event (NULL for null)."""
    return [held[name].alias(name) for name in ATOMIC_FIELDS]


def _held(document):
    """The fields of a document as texts; a struct, since a map is searched through for each of its keys."""
    return F.from_json(document, ", ".join(f"`{name}` string" for name in (*ATOMIC_FIELDS, "payload"))).alias("held")


def _routed_projection(r: DataFrame) -> DataFrame:
    """All fields of the rendered data as one text; a bad row's payload stands for its event id."""
    r = r.select("*", _held("data"))
    texts = [F.coalesce(c, F.lit("~")) for c in _json_texts(F.col("held"))]
    payload = F.col("held")["payload"]
    return r.select("stream", "schema", F.coalesce(F.col("event_id"), payload).alias("event_id"),
                    F.when(payload.isNull(), F.array_join(F.array(*texts), "|")).alias("fields"))


def q_route_by_stream(s, sf):
    return _routed_projection(tsv.route_by_stream(enriched_lines(s, sf)))


def q_tag_schema(s, sf):
    lines = enriched_lines(s, sf)
    return lines.select("stream", tsv.tag_schema(F.col("stream")).alias("schema")).groupBy("stream", "schema") \
        .agg(F.count(F.lit(1)).alias("n"))


def q_event_to_json(s, sf):
    parsed = tsv.read_enriched_tsv(enriched_lines(s, sf).filter(F.col("stream") == "enriched-good"))
    return parsed.select(_held(tsv.event_to_json(parsed))).select(*_json_texts(F.col("held")))


def q_sink_fan_out(s, sf):
    p1, p2 = scratch(s, "fan1"), scratch(s, "fan2")
    lake.sink_fan_out(atomic(s, sf), [lambda d: lake.write_events(d, p1), lambda d: lake.write_events(d, p2)])
    return s.read.parquet(p1).unionByName(s.read.parquet(p2))


def q_append_schema_data(s, sf):
    p = scratch(s, "debug")
    routed = tsv.route_by_stream(enriched_lines(s, sf)).filter(F.col("stream") != "enriched-bad")
    lake.append_schema_data(routed, p)
    lake.append_schema_data(routed, p)
    back = s.read.parquet(p)
    return back.select("schema", F.get_json_object("data", "$.event_id").alias("event_id"))


def q_scan_csv_seed(s, sf):
    p = scratch(s, "seed")
    read_table(s, sf, "nation").write.option("header", True).csv(p)
    return read_seed_csv(s, p, "n_nationkey int, n_name string, n_regionkey int")


def _stream_source(s, sf, parts=1):
    """Fixture events, whole rows, written as parquet files for a file stream source."""
    src = scratch(s, "src")
    sub = atomic(s, sf)
    if parts == 1:
        sub.write.parquet(src)
    else:
        sub.filter(_n() % 2 == 0).write.mode("append").parquet(src)
    return src, sub


def q_append_windowed(s, sf):
    src, sub = _stream_source(s, sf)
    out, ck = scratch(s, "lake"), scratch(s, "ck")
    q = T.stream_load(s.readStream.schema(sub.schema).parquet(src), out, ck, trigger="availableNow")
    q.awaitTermination()
    return s.read.parquet(out)


def q_resume_from_checkpoint(s, sf):
    """Two availableNow runs with new files in between == one run over everything."""
    src, sub = _stream_source(s, sf, parts=2)
    out, ck = scratch(s, "lake"), scratch(s, "ck")
    T.stream_load(s.readStream.schema(sub.schema).parquet(src), out, ck, trigger="availableNow").awaitTermination()
    sub.filter(_n() % 2 == 1).write.mode("append").parquet(src)
    T.stream_load(s.readStream.schema(sub.schema).parquet(src), out, ck, trigger="availableNow").awaitTermination()
    return s.read.parquet(out)


def q_batch_by_size_or_delay(s, sf):
    a = atomic(s, sf)
    size = F.octet_length("event_id") + F.octet_length("page_url")
    return lake.batch_by_size_or_delay(a, "collector_tstamp", size, 2000, "1 minute").select(
        "event_id", "collector_tstamp", "batch_window", "batch_no")


def q_start_position(s, sf):
    return lake.start_position(atomic(s, sf), "AT_TIMESTAMP", at="2024-01-16 00:00:00") \
        .select("event_id", "collector_tstamp")


SKIP = ["iglu:com.acme/page_ping/jsonschema/1-*-*", "iglu:com.acme/screen_end/jsonschema/1-0-*",
        "iglu:com.acme/transaction/jsonschema/1-1-1"]


def _schema_key():
    n = _n()
    return F.concat(F.lit("iglu:com.acme/"), F.col("event_name"), F.lit("/jsonschema/1-"),
                    (n % 3).cast("string"), F.lit("-"), (n % 2).cast("string"))


def q_skip_schemas(s, sf):
    a = atomic(s, sf).withColumn("schema", _schema_key())
    return lake.skip_schemas(a, "schema", SKIP).select("event_id", "schema")


def q_write_parquet_snappy(s, sf):
    p = scratch(s, "snappy")
    lake.write_events(atomic(s, sf), p, mode="overwrite", compression="snappy")
    return s.read.parquet(p)


def q_dead_letter_split(s, sf):
    a = atomic(s, sf).withColumn("failure", F.when(F.col("tr_total_base") > 400, F.lit("amount too large")))
    good, bad = lake.dead_letter_split(a)
    return good.select("event_id", F.lit("good").alias("output")).unionByName(
        bad.select("event_id", F.lit("bad").alias("output")))


def _batch_no():
    """Batch that brings an event: by day, but every 35th event comes in the last one."""
    return F.when(_n() % 35 == 0, 3).otherwise(F.least(F.lit(3), F.floor((F.dayofmonth("collector_tstamp") - 1) / 8))).cast("int")


def _late_source(s, sf):
    """Fixture events as a stream of four files; the last holds rows far behind the others."""
    src = scratch(s, "late-src")
    a = atomic(s, sf).select("event_id", "collector_tstamp", "event_name")
    for k in range(4):
        a.filter(_batch_no() == k).coalesce(1).write.mode("append").parquet(src)
    return s.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(src)


def q_metrics_late(s, sf):
    out, ck = scratch(s, "late"), scratch(s, "ck")
    late.pipeline_metrics(_late_source(s, sf), "collector_tstamp", out, ck, "1 day", "event_name", "1 hour").awaitTermination()
    on_time = late.result(s, out, ("event_name",), {"n": "sum"})
    behind = late.late_rows(s, out).groupBy("event_name").agg(F.count("*").alias("n"))
    return on_time.select(F.lit("on time").alias("place"), F.col("period_start").cast("date").alias("day"), "event_name", "n").unionByName(
        behind.select(F.lit("late").alias("place"), F.lit(None).cast("date").alias("day"), "event_name", "n"))


def q_dedupe_late(s, sf):
    out, ck = scratch(s, "late"), scratch(s, "ck")
    late.dedupe(_late_source(s, sf), out, ck, "event_id", "collector_tstamp", "1 hour").awaitTermination()
    return late.kept_rows(s, out).select(F.lit("kept").alias("place"), "event_id", "collector_tstamp").unionByName(
        late.late_rows(s, out).select(F.lit("late").alias("place"), "event_id", "collector_tstamp"))


def q_stream_fan_out(s, sf):
    """Two sinks; then all batches once more under their old ids, as after a lost checkpoint."""
    one, two, ledger = scratch(s, "one"), scratch(s, "two"), scratch(s, "ledger")
    sinks = {"one": lambda d, b: lake.write_events(d, one), "two": lake.write_batch(two)}
    for _ in range(2):
        T.stream_fan_out(_late_source(s, sf), sinks, ledger, scratch(s, "ck")).awaitTermination()
    return s.read.parquet(one).unionByName(s.read.parquet(two).drop("batch"))


def q_stream_start(s, sf):
    """AT_TIMESTAMP over a folder: files that were there before are not read."""
    src, out = scratch(s, "start-src"), scratch(s, "start-out")
    a = atomic(s, sf)
    a.filter(_n() % 2 == 0).write.mode("append").parquet(src)
    time.sleep(1.1)
    begin = datetime.now(timezone.utc)
    a.filter(_n() % 2 == 1).write.mode("append").parquet(src)
    stream = start.read_folder(s, "parquet", src, "AT_TIMESTAMP", f"{out}-state", begin, schema=a.schema)
    T.stream_load(stream, out, f"{out}-ck", trigger="availableNow").awaitTermination()
    return s.read.parquet(out)


def _stream_dirs(s, sf):
    """The origin streams as folders of compressed text; a file is one task's lines, so readers need not split it."""
    lines = enriched_lines(s, sf)
    dirs = {}
    for name in STREAM_OF.values():
        d = scratch(s, name)
        lines.filter(F.col("stream") == name).select("value").write.option("compression", "gzip").text(d)
        dirs[name] = d
    return dirs


def q_stream_parse_route(s, sf):
    out, ck = scratch(s, "routed"), scratch(s, "ck")
    T.stream_parse_route(s, _stream_dirs(s, sf), out, ck).awaitTermination()
    return _routed_projection(s.read.parquet(out))


def q_incomplete_same_table(s, sf):
    routed = tsv.route_by_stream(enriched_lines(s, sf))
    good = routed.filter(F.col("stream") == "enriched-good")
    inc = routed.filter(F.col("stream") == "enriched-incomplete")
    p = scratch(s, "events")
    lake.write_events(T.incomplete_same_table(good, inc).select("schema", "data"), p)
    return s.read.parquet(p).select("schema", F.get_json_object("data", "$.event_id").alias("event_id"))


def q_stream_dedupe(s, sf):
    src, sub = _stream_source(s, sf)
    out, ck = scratch(s, "dedup"), scratch(s, "ck")
    st = T.stream_dedupe(s.readStream.schema(sub.schema).parquet(src))
    T.stream_load(st, out, ck, trigger="availableNow").awaitTermination()
    return s.read.parquet(out).select("event_id")


def q_pipeline_metrics(s, sf):
    a = atomic(s, sf)
    n = _n()
    tagged = a.withColumn("stream", F.when(n % 3 == 0, STREAM_OF[0]).when(n % 3 == 1, STREAM_OF[1])
                          .otherwise(STREAM_OF[2]))
    return T.pipeline_metrics(tagged, "collector_tstamp", "10 minutes")


QUERIES = {
    "read_enriched_tsv": q_read_enriched_tsv,
    "union_tagged_streams": q_union_tagged_streams,
    "route_by_stream": q_route_by_stream,
    "tag_schema": q_tag_schema,
    "event_to_json": q_event_to_json,
    "sink_fan_out": q_sink_fan_out,
    "append_schema_data": q_append_schema_data,
    "scan_lake_table": lambda s, sf: lake.scan_lake_table(s, f"{sf.rstrip('/')}/events.parquet"),
    "scan_csv_seed": q_scan_csv_seed,
    "append_windowed": q_append_windowed,
    "batch_by_size_or_delay": q_batch_by_size_or_delay,
    "start_position": q_start_position,
    "resume_from_checkpoint": q_resume_from_checkpoint,
    "partition_output": lambda s, sf: lake.partition_output(atomic(s, sf), "domain_userid", 8)
        .select("event_id", "domain_userid"),
    "skip_schemas": q_skip_schemas,
    "write_parquet_snappy": q_write_parquet_snappy,
    "dead_letter_split": q_dead_letter_split,
    "stream_parse_route": q_stream_parse_route,
    "stream_load": q_append_windowed,
    "pipeline_metrics": q_pipeline_metrics,
    "latency_health": lambda s, sf: T.latency_health(atomic(s, sf), "collector_tstamp", "derived_tstamp", "10 minutes"),
    "incomplete_same_table": q_incomplete_same_table,
    "stream_dedupe": q_stream_dedupe,
    "metrics_with_late_rows": q_metrics_late,
    "dedupe_with_late_rows": q_dedupe_late,
    "stream_fan_out": q_stream_fan_out,
    "stream_start_at_timestamp": q_stream_start,
}

# ------------------------------------------------------------------------- oracles

_N = "CAST(substr(event_id, 2) AS BIGINT)"


def _line_sql():
    f = {
        "app_id": "app_id", "platform": "platform", "collector_tstamp": "CAST(collector_tstamp AS VARCHAR)",
        "event": "event_name", "event_id": "event_id", "user_id": "user_id", "user_ipaddress": "user_ipaddress",
        "domain_userid": "domain_userid", "page_url": "page_url", "page_urlquery": "page_urlquery",
        "contexts": f"CASE {_N} % 4 WHEN 0 THEN '{{\"a\":1}}' WHEN 1 THEN '{{bad' ELSE '' END",
        "useragent": "useragent",
        "br_cookies": f"CASE {_N} % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'x' END",
        "br_viewwidth": "CAST(br_viewwidth AS VARCHAR)",
        "doc_width": f"CASE WHEN {_N} % 10 = 0 THEN 'abc' ELSE CAST(doc_width AS VARCHAR) END",
        "tr_total_base": "CAST(tr_total_base AS VARCHAR)", "domain_sessionid": "domain_sessionid",
        "derived_tstamp": "CAST(derived_tstamp AS VARCHAR)",
    }
    cells = [f"coalesce({f[n]}, '')" if n in f else _other_sql(n, i) for i, n in enumerate(ATOMIC_FIELDS)]
    full = " || chr(9) || ".join(cells)
    ragged = " || chr(9) || ".join(cells[:RAGGED_FIELDS])
    bad = f"'{{\"schema\":\"{BAD_SCHEMA}\",\"data\":{{\"payload\":\"' || event_id || '\"}}}}'"
    return (f"lines AS (SELECT CASE {_N} % 3 WHEN 0 THEN 'enriched-good' WHEN 1 THEN 'enriched-incomplete' "
            f"ELSE 'enriched-bad' END AS stream, CASE WHEN {_N} % 3 = 2 THEN {bad} WHEN {_N} % 25 = 0 THEN {ragged} "
            f"ELSE {full} END AS value, event_id AS src_event_id FROM atomic)")


def _field(name, typed=True):
    raw = f"string_split(value, chr(9))[{POS[name] + 1}]"
    if not typed:
        return raw
    if name in NUMBER_FIELDS:
        return f"TRY_CAST({raw} AS DOUBLE)"
    if name in BOOL_FIELDS:
        return f"TRY_CAST({raw} AS BOOLEAN)"
    if name in JSON_FIELDS:
        return f"CASE WHEN json_valid({raw}) AND {raw} <> '' THEN {raw} END"
    return raw


LINES = ATOMIC + [_line_sql()]
S01_SQL = "SELECT " + ", ".join(f"{_field(c)} AS {c}" for c in ATOMIC_FIELDS) + " FROM lines WHERE stream <> 'enriched-bad'"


def _text_sql(name: str) -> str:
    """Text of a parsed field as JSON shows it."""
    return f"CAST({_field(name)} AS VARCHAR)"


ROUTED_SQL = (
    "SELECT stream, CASE stream WHEN 'enriched-good' THEN 'iglu:io.snowplow/good/jsonschema/1-0-0' "
    "ELSE 'iglu:io.snowplow/incomplete/jsonschema/1-0-0' END AS schema, "
    f"{_field('event_id')} AS event_id, array_to_string([" + ", ".join(f"coalesce({_text_sql(c)}, '~')" for c in ATOMIC_FIELDS)
    + "], '|') AS fields FROM lines WHERE stream <> 'enriched-bad' "
    f"UNION ALL SELECT stream, '{BAD_SCHEMA}', src_event_id, NULL FROM lines WHERE stream = 'enriched-bad'")

WHOLE = with_ctes(ATOMIC, "SELECT * FROM atomic")
SKIP_SQL = (f"SELECT event_id, 'iglu:com.acme/' || event_name || '/jsonschema/1-' || CAST({_N} % 3 AS VARCHAR) || '-' || "
            f"CAST({_N} % 2 AS VARCHAR) AS schema FROM atomic")
STREAM_SQL = f"CASE {_N} % 3 WHEN 0 THEN 'enriched-good' WHEN 1 THEN 'enriched-incomplete' ELSE 'enriched-bad' END"

_LATE = f"""late_src AS (SELECT event_id, collector_tstamp AS t, event_name, CASE WHEN {_N} % 35 = 0 THEN 3
             ELSE least(3, (day(collector_tstamp) - 1) // 8) END AS b FROM atomic),
late_wm AS (SELECT x.b, max(s.t) - INTERVAL 1 HOUR AS wm FROM (VALUES (0), (1), (2), (3)) x(b) JOIN late_src s ON s.b < x.b GROUP BY 1)"""
METRICS_LATE_SQL = with_ctes(ATOMIC + [_LATE], """SELECT place, day, event_name, count(*) AS n FROM (
  SELECT CASE WHEN wm IS NOT NULL AND date_trunc('day', t) + INTERVAL 1 DAY <= wm THEN 'late' ELSE 'on time' END AS place,
         CASE WHEN wm IS NOT NULL AND date_trunc('day', t) + INTERVAL 1 DAY <= wm THEN NULL ELSE CAST(t AS DATE) END AS day, event_name
  FROM late_src LEFT JOIN late_wm USING (b)) GROUP BY ALL""")
DEDUPE_LATE_SQL = with_ctes(ATOMIC + [_LATE], """SELECT place, event_id, t AS collector_tstamp FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, place ORDER BY t) AS k FROM (
    SELECT CASE WHEN wm IS NOT NULL AND t < wm THEN 'late' ELSE 'kept' END AS place, event_id, t
    FROM late_src LEFT JOIN late_wm USING (b))) WHERE place = 'late' OR k = 1""")

ORACLE = {
    "read_enriched_tsv": with_ctes(LINES, S01_SQL),
    "union_tagged_streams": with_ctes(LINES, "SELECT value, stream FROM lines"),
    "route_by_stream": with_ctes(LINES, ROUTED_SQL),
    "tag_schema": with_ctes(LINES, "SELECT stream, CASE stream WHEN 'enriched-good' THEN 'iglu:io.snowplow/good/jsonschema/1-0-0' "
                                   "WHEN 'enriched-incomplete' THEN 'iglu:io.snowplow/incomplete/jsonschema/1-0-0' END AS schema, "
                                   "count(*) AS n FROM lines GROUP BY ALL"),
    "event_to_json": with_ctes(LINES, "SELECT " + ", ".join(f"{_text_sql(c)} AS {c}" for c in ATOMIC_FIELDS)
                               + " FROM lines WHERE stream = 'enriched-good'"),
    "append_schema_data": with_ctes(LINES, "SELECT schema, event_id FROM (SELECT CASE stream WHEN 'enriched-good' THEN "
                                           "'iglu:io.snowplow/good/jsonschema/1-0-0' ELSE 'iglu:io.snowplow/incomplete/jsonschema/1-0-0' "
                                           f"END AS schema, {_field('event_id')} AS event_id FROM lines WHERE stream <> 'enriched-bad') "
                                           "CROSS JOIN (VALUES (1), (2)) t(copy)"),
    "scan_lake_table": "SELECT * FROM events",
    "scan_csv_seed": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "metrics_with_late_rows": METRICS_LATE_SQL,
    "dedupe_with_late_rows": DEDUPE_LATE_SQL,
    "stream_fan_out": with_ctes(ATOMIC, "SELECT event_id, collector_tstamp, event_name FROM atomic UNION ALL "
                                        "SELECT event_id, collector_tstamp, event_name FROM atomic"),
    "stream_start_at_timestamp": with_ctes(ATOMIC, f"SELECT * FROM atomic WHERE {_N} % 2 = 1"),
    "sink_fan_out": with_ctes(ATOMIC, "SELECT * FROM atomic UNION ALL SELECT * FROM atomic"),
    "append_windowed": WHOLE,
    "stream_load": WHOLE,
    "resume_from_checkpoint": WHOLE,
    "write_parquet_snappy": WHOLE,
    "batch_by_size_or_delay": with_ctes(ATOMIC, "SELECT event_id, collector_tstamp, batch_window, CAST(floor((sum(sz) OVER (PARTITION BY "
                                                "batch_window ORDER BY collector_tstamp, event_id ROWS UNBOUNDED PRECEDING) - 1) / 2000) "
                                                "AS BIGINT) AS batch_no FROM (SELECT *, time_bucket(INTERVAL '1 minute', collector_tstamp) "
                                                "AS batch_window, strlen(event_id) + strlen(page_url) AS sz FROM atomic)"),
    "start_position": with_ctes(ATOMIC, "SELECT event_id, collector_tstamp FROM atomic WHERE collector_tstamp >= "
                                        "TIMESTAMP '2024-01-16 00:00:00'"),
    "partition_output": with_ctes(ATOMIC, "SELECT event_id, domain_userid FROM atomic"),
    "skip_schemas": with_ctes(ATOMIC, f"SELECT * FROM ({SKIP_SQL}) WHERE NOT (schema LIKE 'iglu:com.acme/page_ping/jsonschema/1-%' "
                                      "OR schema LIKE 'iglu:com.acme/screen_end/jsonschema/1-0-%' "
                                      "OR schema = 'iglu:com.acme/transaction/jsonschema/1-1-1')"),
    "dead_letter_split": with_ctes(ATOMIC, "SELECT event_id, CASE WHEN tr_total_base > 400 THEN 'bad' ELSE 'good' END AS output "
                                           "FROM atomic"),
    "stream_parse_route": with_ctes(LINES, ROUTED_SQL),
    "pipeline_metrics": with_ctes(ATOMIC, f"SELECT time_bucket(INTERVAL '10 minutes', collector_tstamp) AS period_start, "
                                          f"{STREAM_SQL} AS stream, count(*) AS n FROM atomic GROUP BY ALL"),
    "latency_health": with_ctes(ATOMIC, "SELECT time_bucket(INTERVAL '10 minutes', collector_tstamp) AS period_start, "
                                        "max((epoch_us(collector_tstamp) - epoch_us(derived_tstamp)) / 1e6) AS max_latency_s, "
                                        "max((epoch_us(collector_tstamp) - epoch_us(derived_tstamp)) / 1e6) > 120 AS unhealthy "
                                        "FROM atomic GROUP BY ALL"),
    "incomplete_same_table": with_ctes(LINES, "SELECT CASE stream WHEN 'enriched-good' THEN 'iglu:io.snowplow/good/jsonschema/1-0-0' "
                                              "ELSE 'iglu:io.snowplow/incomplete/jsonschema/1-0-0' END AS schema, "
                                              f"{_field('event_id')} AS event_id FROM lines WHERE stream <> 'enriched-bad'"),
    "stream_dedupe": with_ctes(ATOMIC, "SELECT DISTINCT event_id FROM atomic"),
}
