"""Registered queries of validation by schema key, and their oracles.

Each event is rendered with its own self-describing data and an entity array by
a fixed rule that plants violations; the oracles state the same rule in SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import selfdescribing as S
from trailmark.operators.validate import FAILURE_SCHEMA
from trailmark.sources.tables import read_table


def _key(name: str) -> str:
    return f"iglu:com.acme/{name}/jsonschema/1-0-0"


#: schema key -> body; events of the types error and purchase have no schema here
CATALOG = {
    _key("view"): {"type": "object", "required": ["page"], "properties": {"page": {"type": "string", "maxLength": 5},
                                                                         "amount": {"type": "number"}}},
    _key("click"): {"type": "object", "properties": {"page": {"type": "string"},
                                                     "amount": {"$ref": _key("money") + "#/properties/amount"}}},
    _key("signup"): {"type": "object"},
    _key("cart"): {"type": "object", "required": ["items", "owner"], "additionalProperties": False,
                   "definitions": {"owner": {"type": "object", "required": ["id"],
                                             "properties": {"id": {"type": "integer", "multipleOf": 2}}}},
                   "properties": {"owner": {"$ref": "#/definitions/owner"},
                                  "items": {"type": "array", "maxItems": 2, "items": {"$ref": _key("money")}}}},
    _key("money"): {"type": "object", "properties": {"amount": {"type": "number", "maximum": 400}}},
}


def catalog(spark) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in CATALOG.items()], "schema_key string, body string")


def events(spark, sf) -> DataFrame:
    """(event_id, unstruct_event, contexts, derived_contexts)."""
    e = read_table(spark, sf, "events")
    n = F.col("event_id")
    amount = F.round("value", 2)
    own = F.struct(
        F.lit("iglu:com.acme/unstruct_event/jsonschema/1-0-0").alias("schema"),
        F.struct(F.concat(F.lit("iglu:com.acme/"), F.col("event_type"), F.lit("/jsonschema/1-0-0")).alias("schema"),
                 F.struct(F.when(n % 7 != 0, F.concat(F.lit("p"), n.cast("string"))).alias("page"),
                          amount.alias("amount")).alias("data")).alias("data"))
    money = F.to_json(F.struct(amount.alias("amount")))
    cart = F.concat(F.lit('{"schema":"' + _key("cart") + '","data":{"owner":{"id":'),
                    F.when(n % 11 == 0, F.lit('"none"')).otherwise(n.cast("string")), F.lit('},"items":['),
                    F.array_join(F.array_repeat(money, (n % 4).cast("int")), ","),
                    F.when(n % 13 == 0, F.lit('],"note":1}}')).otherwise(F.lit("]}}")))
    wallet = F.concat(F.lit('{"schema":"' + _key("money") + '","data":'), money, F.lit("}"))
    contexts = F.concat(F.lit('{"schema":"' + S.CONTEXTS_SCHEMA + '","data":['), cart,
                        F.when(n % 3 == 0, F.concat(F.lit(","), wallet)).otherwise(F.lit("")), F.lit("]}"))
    return e.select(
        "event_id", F.when(n % 29 == 0, F.lit("{broken")).when(n % 31 != 0, F.to_json(own)).alias("unstruct_event"),
        F.when(n % 5 != 0, contexts).alias("contexts"),
        F.when(n % 2 == 0, F.concat(F.lit('{"schema":"' + S.CONTEXTS_SCHEMA + '","data":['), wallet, F.lit("]}")))
        .alias("derived_contexts"))


def _found(spark, sf) -> DataFrame:
    return S.violations(S.entities(events(spark, sf), ["event_id"]), catalog(spark), ["event_id"])


def _checked(spark, sf) -> DataFrame:
    return S.with_errors(events(spark, sf), _found(spark, sf), ["event_id"])


def q_errors(spark, sf):
    return _checked(spark, sf).select("event_id", F.size("errors").cast("long").alias("n_errors"),
                                      F.size(F.array_distinct("errors.schema")).cast("long").alias("n_schemas"))


def q_failure(spark, sf):
    """Entities of each incomplete event's derived contexts, the failure entity among them."""
    done = S.routed(_checked(spark, sf)).filter("output = 'incomplete'")
    data = F.try_variant_get(F.try_parse_json("derived_contexts"), "$.data", "array<variant>")
    last = F.element_at(data, -1)
    return done.select("event_id", F.size(data).cast("long").alias("n_entities"),
                       F.try_variant_get(last, "$.schema", "string").alias("failure_schema"),
                       F.size(F.try_variant_get(last, "$.data.errors", "array<variant>")).cast("long").alias("n_errors"))


QUERIES = {
    "validate_by_schema": _found,
    "validate_events_by_schema": q_errors,
    "failure_in_derived_contexts": q_failure,
    "route_validated_events": lambda s, sf: S.routed(_checked(s, sf)).groupBy("output").agg(
        F.count("*").alias("n"), F.count("derived_contexts").alias("n_derived")),
}

_V = f"""
WITH e AS (SELECT event_id, event_id AS n, event_type, round(value, 2) AS amount FROM events),
own AS (SELECT *, 'unstruct_event' AS place, 0 AS position, 'iglu:com.acme/' || event_type || '/jsonschema/1-0-0' AS schema
        FROM e WHERE n % 29 <> 0 AND n % 31 <> 0),
cart AS (SELECT *, 'contexts' AS place, 0 AS position, '{_key("cart")}' AS schema FROM e WHERE n % 5 <> 0),
money AS (SELECT *, 'contexts' AS place, 1 AS position, '{_key("money")}' AS schema FROM e WHERE n % 5 <> 0 AND n % 3 = 0
          UNION ALL SELECT *, 'derived_contexts', 0, '{_key("money")}' FROM e WHERE n % 2 = 0),
v AS (
  SELECT event_id, 'unstruct_event' AS place, 0 AS position, NULL AS schema, '$' AS path, 'json' AS keyword FROM e WHERE n % 29 = 0
  UNION ALL SELECT event_id, place, position, schema, '$', 'schema' FROM own
            WHERE schema NOT IN ({", ".join(f"'{k}'" for k in CATALOG)})
  UNION ALL SELECT event_id, place, position, schema, '$.page', 'required' FROM own WHERE event_type = 'view' AND n % 7 = 0
  UNION ALL SELECT event_id, place, position, schema, '$.page', 'maxLength' FROM own
            WHERE event_type = 'view' AND n % 7 <> 0 AND length('p' || n) > 5
  UNION ALL SELECT event_id, place, position, schema, '$.amount', 'maximum' FROM own WHERE event_type = 'click' AND amount > 400
  UNION ALL SELECT event_id, place, position, schema, '$.owner.id', 'type' FROM cart WHERE n % 11 = 0
  UNION ALL SELECT event_id, place, position, schema, '$.owner.id', 'multipleOf' FROM cart WHERE n % 11 <> 0 AND n % 2 = 1
  UNION ALL SELECT event_id, place, position, schema, '$.items', 'maxItems' FROM cart WHERE n % 4 > 2
  UNION ALL SELECT event_id, place, position, schema, '$.items[*]', 'items' FROM cart WHERE n % 4 > 0 AND amount > 400
  UNION ALL SELECT event_id, place, position, schema, '$', 'additionalProperties' FROM cart WHERE n % 13 = 0
  UNION ALL SELECT event_id, place, position, schema, '$.amount', 'maximum' FROM money WHERE amount > 400)
"""

_PER_EVENT = "(SELECT event_id, count(*) AS n_errors, count(DISTINCT coalesce(schema, '')) AS n_schemas FROM v GROUP BY 1)"

ORACLE = {
    "validate_by_schema": _V + "SELECT event_id, place, CAST(position AS INTEGER) AS position, schema, path, keyword FROM v",
    "validate_events_by_schema": _V + f"SELECT e.event_id, coalesce(n_errors, 0) AS n_errors, coalesce(n_schemas, 0) AS n_schemas "
                                      f"FROM e LEFT JOIN {_PER_EVENT} p USING (event_id)",
    "failure_in_derived_contexts": _V + f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n_entities, "
                                        f"'{FAILURE_SCHEMA}' AS failure_schema, n_errors FROM {_PER_EVENT}",
    "route_validated_events": _V + f"""SELECT output, count(*) AS n, count(*) FILTER (WHERE output = 'incomplete' OR event_id % 2 = 0) AS n_derived
FROM (SELECT e.event_id, unnest(CASE WHEN p.event_id IS NULL THEN ['good'] ELSE ['bad', 'incomplete'] END) AS output
      FROM e LEFT JOIN {_PER_EVENT} p USING (event_id)) GROUP BY 1""",
}
