"""Instructions on values, and the schemas of interfaces."""

import json

from tracequarry.operators import evidence
from tracequarry.sources import files


def test_value_instructions(spark):
    texts = [
        (1, "The countryCode shall accept CA, FR and us. Continue to reject FR or DE;\nexcluding only XY. For tier allow GOLD; REJECT Silver. Keep supporting values AA"),
        (2, "accept CA. countryCode. accept CA\nCOUNTRYCODE: deny ca"), (3, "countryCode and tier: accept AA; reject AA. countryCodes reject ZZ"), (4, None), (5, ""), (6, "countryCode accepts 12 and disallow the code CA"),
    ]
    attributes = spark.createDataFrame([(d, a) for d in range(1, 7) for a in ("countryCode", "tier")] + [(2, None)], "doc_id int, attribute string")
    got = evidence.value_instructions(spark.createDataFrame(texts, "doc_id int, text string"), attributes)
    told = {}
    for r in got.collect():
        told.setdefault((r.doc_id, r.attribute, r.polarity), set()).add(r.value)
    assert told == {
        (1, "countryCode", "ACCEPT"): {"CA", "FR", "US"}, (1, "countryCode", "REJECT"): {"FR", "DE", "XY"}, (1, "tier", "ACCEPT"): {"GOLD", "AA"}, (1, "tier", "REJECT"): {"SILVER"},
        (2, "countryCode", "ACCEPT"): {"CA"}, (2, "countryCode", "REJECT"): {"CA"}, (3, "countryCode", "ACCEPT"): {"AA"}, (3, "tier", "ACCEPT"): {"AA"}, (3, "countryCode", "REJECT"): {"AA", "ZZ"}, (3, "tier", "REJECT"): {"AA", "ZZ"},
    }
    conflicts = {(r.doc_id, r.attribute): (r["values"], r.accepting, r.rejecting) for r in evidence.instruction_conflicts(got).collect()}
    assert conflicts == {(1, "countryCode"): (["FR"], [0], [1]), (2, "countryCode"): (["CA"], [2], [3]), (3, "countryCode"): (["AA"], [0], [1]), (3, "tier"): (["AA"], [0], [1])}


def test_openapi_schemas(spark):
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    spec = {
        "paths": {"/a": {"post": {"requestBody": {"content": {"json": {"schema": {"allOf": [ref("A"), {"x": [ref("B"), ref("A")]}]}}}}, "responses": {"200": ref("C"), "400": {"note": '{"$ref": "#/components/schemas/No"}', "$ref": "other.json#/D"}}, "description": ref("E")}, "parameters": [ref("F")]}, "/b": None},
        "components": {"schemas": {"A": {"properties": {"id": {"type": "integer"}, "of": ref("B"), "odd": 3}}, "B": {}, "C": []}},
    }
    df = spark.createDataFrame([("s", json.dumps(spec)), ("t", "broken"), ("u", None), ("v", "[1]")], "spec string, text string")
    assert sorted(map(tuple, files.openapi_schemas(df).collect()), key=str) == sorted([
        ("s", "REQUEST", "/a", "post", "A", None), ("s", "REQUEST", "/a", "post", "B", None), ("s", "RESPONSE", "/a", "post", "C", None),
        ("s", "PROPERTY", "A", None, "id", "integer"), ("s", "PROPERTY", "A", None, "of", "B"), ("s", "PROPERTY", "A", None, "odd", None),
    ], key=str)
    assert files.schema_refs(None) == []
