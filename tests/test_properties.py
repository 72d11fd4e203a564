"""Schema-less properties: odd JSON, deep lists, spellings, categories and site maps."""

import json

from cairn.functions import properties as P
from cairn.sources.scratch import keeper

BAGS = [
    (1, '{"a": 1, "b": [1, "x", {"c": [true, null, 2.5]}], "d": {}, "e": [], "f.g": "dot", "h": ""}'), (2, "[1, 2]"), (3, "not json"), (4, None), (5, '"text"'), (6, "{}"), (7, "null"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, bag string")


def test_keys_and_kinds(spark):
    got = {(r.id, r.prop): r.kind for r in P.properties(frame(spark, BAGS), "id", "bag").collect()}
    assert got == {(1, "a"): "BIGINT", (1, "b"): "ARRAY<VARIANT>", (1, "d"): "OBJECT<>", (1, "e"): "ARRAY<VOID>", (1, "f.g"): "STRING", (1, "h"): "STRING"}


def test_all_scalars_at_any_depth(spark):
    got = {(r.id, r.path): r.value for r in P.leaves(frame(spark, BAGS), "id", "bag", keeper(spark)).collect()}
    assert got == {
        (1, "$.a"): "1", (1, "$.b[0]"): "1", (1, "$.b[1]"): "x", (1, "$.b[2].c[0]"): "true", (1, "$.b[2].c[1]"): None, (1, "$.b[2].c[2]"): "2.5", (1, "$.f.g"): "dot", (1, "$.h"): "",
        (2, "$[0]"): "1", (2, "$[1]"): "2", (5, "$"): "text", (7, "$"): None,
    }


def test_weights_in_two_spellings(spark):
    rows = [
        (1, {"weight_grams": 100, "weightGrams": 80, "weight_oz": 4, "weightOunces": 4}), (2, {"weight_grams": 100, "weightGrams": "100"}), (3, {"weight_grams": 5, "weight": 1}), (4, {"weightGrams": 0, "weight_oz": 3}),
        (5, {"name": "x"}), (6, {"weightGrams": 7, "base_weight": 1}), (7, {"weight_grams": None, "weightGrams": 9}),
    ]
    got = {r.id: tuple(r)[1:] for r in P.weight_consistency(frame(spark, [(i, json.dumps(b)) for i, b in rows]), "id", "bag").collect()}
    assert got[1] == (["weightGrams", "weightOunces", "weight_grams", "weight_oz"], True, 1, 20.0, 100.0)
    assert got[2][1:] == (True, 0, None, 100.0) and got[3][1:] == (False, 0, None, None) and got[4][1:] == (True, 0, None, None)
    assert 5 not in got and got[6][1:] == (True, 0, None, 7.0) and got[7][1:] == (True, 0, None, 9.0)


def test_completeness_asks_for_the_fields_of_the_category(spark):
    full = {"weight_grams": 0, "description": "d", "price_usd": 1, "materials": ["x"], "features": "f", "productUrl": "u"}
    rows = [
        (1, full), (2, full | {"category": "Ultralight Tents"}), (3, full | {"category": "tent", "capacityPersons": 2, "waterproofRating": None}), (4, {"description": "", "materials": [], "price_usd": None}),
        (5, {"category": "Sleeping Bag", "tempRatingF": -5}), (6, full | {"category": "backpack tent", "volumeLiters": 40}),
    ]
    got = {r.id: r.score for r in P.completeness(frame(spark, [(i, json.dumps(b)) for i, b in rows] + [(7, None), (8, "x")]), "id", "bag").collect()}
    assert got == {1: 1.0, 2: round(8 / 11, 6), 3: round(10 / 11, 6), 4: 0.0, 5: round(2 / 11, 6), 6: 1.0, 7: 0.0, 8: 0.0}


def test_attributes_are_set(spark):
    given = spark.createDataFrame([(1, "a", "2"), (1, "new \"list\"", '["x", 1]'), (1, "b", '"text"'), (2, "x", "no json"), (9, "x", "1")], "id long, attr string, value string")
    out = {r.id: r.bag for r in P.with_attributes(frame(spark, [(1, '{"a": 1, "b": [1], "c": {"d": null}}'), (2, '{"k":1}'), (3, "odd")]), "id", "bag", given).collect()}
    assert json.loads(out[1]) == {"a": 2, 'new "list"': '["x",1]', "b": "text", "c": {"d": None}} and json.loads(out[2]) == {"k": 1} and out[3] == "odd"


def test_all_elements_of_all_shapes(spark):
    rows = [(1, '["u1", {"url": "u2"}, {"href": "no"}, 5, null, "u3"]'), (2, '{"links": [{"url": "u4"}, "u5"], "n": 2}'), (3, '{"links": "u6"}'), (4, "{}"), (5, None), (6, "oops"), (7, "[]")]
    assert sorted((r.id, r.pos, r.url) for r in P.map_urls(frame(spark, rows), "id", "bag").collect()) == [(1, 0, "u1"), (1, 1, "u2"), (1, 5, "u3"), (2, 0, "u4"), (2, 1, "u5")]
