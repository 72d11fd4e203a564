"""Turtle texts, triple patterns, class hierarchies and the checks that rest on them."""

import random

from cairn.sources import turtle
from cairn.sources.scratch import keeper
from cairn.sources.turtle import OWL, RDF, RDFS, XSD

TEXT = r"""# a comment with . and "quotes"
@prefix : <http://e.x/o#> . @base <http://b.x/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
prefix owl: <http://www.w3.org/2002/07/owl#>
:Tent a owl:Class ; rdfs:label "Tent", "Zelt. \"groß\""@de-AT ;
    rdfs:comment '''two
"lines". ''' ; ; .
:a.b :p 1, -2.5, 3e2, true, "x"^^:t, <rel>, <http://abs.x/y>, _:n1, "1.0" .
[ :q ( 1 ( "two" ) [ :r :s ] ) ; :empty () ] .
[] :t "it's" . _:n1 :u 'a\tb' .
:broken :p nosuch:thing . :broken "text" :x .
:fine :p "after the wrong ones" .
:open :p [ :q 1 .
:last :p :v"""


def parsed(spark, text):
    return turtle.parse(spark.createDataFrame([("m", text)], "mark string, value string")).collect()


def test_every_form_is_read(spark):
    rows = parsed(spark, TEXT)
    o = "http://e.x/o#"
    got = [(r.s, r.p, r.o) for r in rows if r.error is None]
    assert got[:5] == [(o + "Tent", RDF + "type", OWL + "Class"), (o + "Tent", RDFS + "label", "Tent"), (o + "Tent", RDFS + "label", 'Zelt. "groß"'), (o + "Tent", RDFS + "comment", 'two\n"lines". '), (o + "a.b", o + "p", "1")]
    kinds = {r.o: (r.kind, r.lang, r.datatype) for r in rows if r.s == o + "a.b"}
    assert kinds == {
        "1": ("literal", None, XSD + "integer"), "-2.5": ("literal", None, XSD + "decimal"), "3e2": ("literal", None, XSD + "double"), "true": ("literal", None, XSD + "boolean"), "x": ("literal", None, o + "t"),
        "http://b.x/rel": ("iri", None, None), "http://abs.x/y": ("iri", None, None), "_:m.n1": ("blank", None, None), "1.0": ("literal", None, XSD + "string"),
    }
    assert [r.lang for r in rows if r.o == 'Zelt. "groß"'] == ["de-at"]
    head = [r.s for r in rows if r.p == o + "q"][0]
    follow = {(r.s, r.p): r.o for r in rows if r.error is None}
    cells = []
    at = follow[head, o + "q"]
    while at != RDF + "nil":
        cells.append(follow[at, RDF + "first"])
        at = follow[at, RDF + "rest"]
    assert cells[0] == "1" and follow[cells[1], RDF + "first"] == "two" and follow[cells[2], o + "r"] == o + "s" and follow[head, o + "empty"] == RDF + "nil"
    assert ("_:m.n1", o + "u", "a\tb") in got and any(x[1:] == (o + "t", "it's") for x in got)
    assert (o + "fine", o + "p", "after the wrong ones") in got and not any("broken" in x[0] or "open" in x[0] or "last" in x[0] for x in got)
    assert len([r for r in rows if r.error]) == 4
    assert parsed(spark, None) == [] and parsed(spark, " # nothing") == []


def test_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.ttl").write_text(f"@prefix : <x:{k}#> . :a :p [ :q {k} ] .")
    t = turtle.triples(spark, str(tmp_path))
    assert t.count() == 6 and t.filter("kind = 'blank'").select("o").distinct().count() == 3


def test_patterns(spark):
    t = spark.createDataFrame([(a, b, c, "iri", None, None, None) for a, b, c in [("x", "p", "y"), ("y", "p", "z"), ("y", "q", "x"), ("z", "p", "z"), ("x", "q", "x")]], turtle.TRIPLE)
    rows = lambda *p: sorted(tuple(r.asDict().items()) for r in turtle.match(t, *p).collect())
    assert rows(("?a", "p", "?b"), ("?b", "p", "?c")) == [(("b", "y"), ("a", "x"), ("c", "z")), (("b", "z"), ("a", "y"), ("c", "z")), (("b", "z"), ("a", "z"), ("c", "z"))]
    assert rows(("?a", "?p", "?a")) == [(("a", "x"), ("p", "q")), (("a", "z"), ("p", "p"))]
    assert rows(("x", "p", "?b"), ("?b", "q", "x")) == [(("b", "y"),)]


def test_closure_against_a_plain_one(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(35)} | {(100 + i, 101 + i) for i in range(20)}
    want = {(a, b) for a, b in pairs if a != b}
    while True:
        more = want | {(a, d) for a, b in want for c, d in want if b == c and a != d}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in turtle.closure(spark.createDataFrame(sorted(pairs), "low long, high long"), keeper(spark)).collect()} == want


def test_labels_and_ends(spark):
    t = turtle.parse(spark.createDataFrame([("m", f"""@prefix : <o:> . @prefix rdfs: <{RDFS}> . @prefix owl: <{OWL}> .
        :T a owl:Class ; rdfs:label "Tent" ; rdfs:subClassOf :S . :S a owl:Class ; rdfs:label "Shelter", "Home" . :B a owl:Class ; rdfs:label "Brand" .
        :m a owl:ObjectProperty ; rdfs:label "made by" ; rdfs:domain :S ; rdfs:range :B . :n a owl:ObjectProperty ; rdfs:label "near" .""")], "mark string, value string"))
    labels = spark.createDataFrame([("TENT",), ("home",), ("pole",), (None,)], "label string")
    assert {r.label: r.valid for r in turtle.checked_labels(t, labels).collect()} == {"TENT": True, "home": True, "pole": False, None: False}
    kinds = [("Tent", "MADE BY", "Brand"), ("Home", "MADE BY", "brand"), ("Brand", "MADE BY", "Brand"), ("Tent", "MADE BY", "Tent"), ("Tent", "NEAR", "Brand"), ("Pole", "NEAR", "Tent"), ("Tent", "X", "Tent")]
    out = turtle.checked_edges(t, spark.createDataFrame(kinds, "src_label string, rel_type string, dst_label string"), keeper(spark)).collect()
    got = {(r.src_label, r.rel_type, r.dst_label): r.verdict for r in out}
    assert [got[k] for k in kinds] == ["valid", "valid", "domain", "range", "valid", "unknown label", "unknown relationship"]


def test_a_file_is_landed_and_parsed_in_parts(spark, sf, tmp_path, monkeypatch):
    from cairn.sources.views import Graph

    monkeypatch.setattr(turtle, "FILE_ROWS", 20)
    turtle.land_ontology(Graph(spark, sf), f"file://{tmp_path}/o")
    files = [p.read_text().count("@prefix : ") for p in (tmp_path / "o").glob("*.txt")]
    assert max(files) <= 20 and sum(files) > 200
    text = "@prefix : <http://x/> .\n" + "".join(f":s{i} :p {i} .\n" for i in range(3 * turtle.SLICE))
    rows = turtle.parse(spark.createDataFrame([("m", text), ("n", "")], "mark string, value string"))
    assert rows.count() == rows.select("s").distinct().count() == 3 * turtle.SLICE
