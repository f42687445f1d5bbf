"""Validation by schema key: references, envelopes, several failing schemas, failure entities in place."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.operators import selfdescribing as S

A, B = "iglu:x/a/jsonschema/1-0-0", "iglu:x/b/jsonschema/1-0-0"


def entity(schema, data):
    return {"schema": schema, "data": data}


def envelope(*items):
    return json.dumps(entity(S.CONTEXTS_SCHEMA, list(items)))


def test_references():
    known = {A: {"properties": {"p": {"$ref": "#/definitions/d~1e"}}, "definitions": {"d/e": {"type": "string", "maxLength": 2}}},
             B: {"items": [{"$ref": A + "#/properties/p"}, {"$ref": A}]}}
    assert S.resolve_refs(known[B], known) == {"items": [{"type": "string", "maxLength": 2},
                                                         {"properties": {"p": {"type": "string", "maxLength": 2}}}]}
    assert S.referred(known) == {A}
    with pytest.raises(ValueError, match="back to itself"):
        S.resolve_refs({"properties": {"next": {"$ref": "#"}}}, {})
    two = {A: {"not": {"$ref": B}}, B: {"not": {"$ref": A}}}
    with pytest.raises(ValueError, match="back to itself"):
        S.resolve_refs(two[A], two)
    with pytest.raises(ValueError, match="not in the catalog"):
        S.resolve_refs({"$ref": B}, {})
    with pytest.raises(ValueError, match="does not exist"):
        S.resolve_refs({"$ref": "#/definitions/none"}, {})


@pytest.fixture(scope="module")
def checked(spark):
    rows = [
        (1, json.dumps(entity("env", entity(A, {"p": "long"}))), envelope(entity(B, {"q": 9}), entity(B, {"q": 1}), entity(B, {"q": 7})), None),
        (2, json.dumps(entity("env", entity(A, {"p": "ok"}))), envelope(), envelope(entity(A, {"p": "x"}))),
        (3, "{", "[1]", "null"),
        (4, json.dumps(entity("env", entity("iglu:x/none/jsonschema/1-0-0", {}))), envelope(3, {"schema": A}), None),
        (5, None, None, envelope(entity(A, {"p": 5}), {"other": [1, {"two": None}]})),
    ]
    events = spark.createDataFrame(rows, "id int, unstruct_event string, contexts string, derived_contexts string")
    catalog = spark.createDataFrame([
        (A, json.dumps({"properties": {"p": {"type": "string", "maxLength": 2}}})),
        (B, json.dumps({"properties": {"q": {"$ref": "#/definitions/n"}}, "definitions": {"n": {"maximum": 5}}})),
        ("unused", "not even json")], "schema_key string, body string")
    found = S.violations(S.entities(events, ["id"]), catalog, ["id"])
    return events, catalog, found


def test_one_event_breaks_two_schemas(checked):
    _, _, found = checked
    got = sorted((r["id"], r["place"], r["position"], r["schema"] or "", r["path"], r["keyword"]) for r in found.collect())
    assert got == sorted([
        (1, "unstruct_event", 0, A, "$.p", "maxLength"), (1, "contexts", 0, B, "$.q", "maximum"), (1, "contexts", 2, B, "$.q", "maximum"),
        (3, "unstruct_event", 0, "", "$", "json"), (3, "contexts", -1, "", "$", "json"), (3, "derived_contexts", -1, "", "$", "json"),
        (4, "unstruct_event", 0, "iglu:x/none/jsonschema/1-0-0", "$", "schema"), (4, "contexts", 0, "", "$", "json"),
        (4, "contexts", 1, A, "$", "json"),
        (5, "derived_contexts", 0, A, "$.p", "type"), (5, "derived_contexts", 1, "", "$", "json")])


def test_missing_schema_ends_the_job_where_asked(checked):
    events, catalog, _ = checked
    with pytest.raises(ValueError, match="iglu:x/none"):
        S.violations(S.entities(events, ["id"]), catalog, ["id"], exit_on_missing=True)


def test_failure_stands_in_the_entity_array(checked):
    events, _, found = checked
    done = {(r["id"], r["output"]): r for r in S.routed(S.with_errors(events, found, ["id"])).collect()}
    assert sorted(done) == [(1, "bad"), (1, "incomplete"), (2, "good"), (3, "bad"), (3, "incomplete"), (4, "bad"),
                            (4, "incomplete"), (5, "bad"), (5, "incomplete")]
    own = {r["id"]: r["derived_contexts"] for r in events.collect()}
    for (i, output), r in done.items():
        if output != "incomplete":
            assert r["derived_contexts"] == own[i]
    whole = json.loads(done[5, "incomplete"]["derived_contexts"])
    assert whole["schema"] == S.CONTEXTS_SCHEMA and len(whole["data"]) == 3
    assert whole["data"][:2] == [entity(A, {"p": 5}), {"other": [1, {"two": None}]}]  # other shapes stay whole
    failure = whole["data"][2]
    assert failure["schema"] == S.FAILURE_SCHEMA and len(failure["data"]["errors"]) == 2
    assert len(json.loads(done[3, "incomplete"]["derived_contexts"])["data"]) == 1


def test_empty_input(spark, checked):
    events, catalog, _ = checked
    none = S.violations(S.entities(events.limit(0), ["id"]), catalog, ["id"])
    assert none.collect() == []
    assert S.with_errors(events, none, ["id"]).filter(F.size("errors") == 0).count() == 5
