"""Turtle files as triples, triple patterns as joins, and the closure of a class hierarchy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.registry import query
from cairn.sources.scratch import fresh_root, keeper
from cairn.sources.views import EDGES, Graph

#: Triples that a task holds at once, and statements of a file that land_ontology writes, which is what one task parses at once.
SLICE, FILE_ROWS = 4096, 5000
TRIPLE = "s string, p string, o string, kind string, lang string, datatype string, error string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: One token: white space and comments, an address, a text in one of four quotes with its tag, a name, a number, a sign.
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)"""
    r'''|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"""|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w:]))"""
    r"""|(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?|[A-Za-z]+)|(?P<sign>[.;,\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s)


class Statements:
    """The triples of one text, a statement at a time; names are written out by the prefixes seen so far."""

    def __init__(self, text: str, mark: str):
        self.text, self.mark = text, mark
        self.prefixes: dict[str, str] = {}
        self.base, self.blanks = "", 0

    def _tokens(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = TOKEN.match(self.text, at)
            if m is None:
                yield "bad", self.text[at]
                at += 1
            else:
                at = m.end()
                if m.lastgroup != "skip":
                    yield m.lastgroup, m[0]

    def _split(self) -> Iterator[list[tuple[str, str]]]:
        """Tokens up to each full stop."""
        part: list[tuple[str, str]] = []
        for token in self._tokens():
            if token == ("sign", "."):
                yield part
                part = []
            else:
                part.append(token)
                if len(part) == 3 and part[0][1].lower() == "prefix" or len(part) == 2 and part[0][1].lower() == "base":
                    yield part
                    part = []
        if part:
            yield [*part, ("bad", "end of text")]

    def rows(self) -> Iterator[tuple]:
        for part in self._split():
            if not part:
                continue
            out: list[tuple] = []
            try:
                if part[0][1].lower() in ("@prefix", "prefix") and len(part) == 3 and part[1][1].endswith(":"):
                    self.prefixes[part[1][1][:-1]] = self._term(part[2])[0]
                elif part[0][1].lower() in ("@base", "base") and len(part) == 2:
                    self.base = self._term(part[1])[0]
                else:
                    self.part, self.at, self.out = part, 0, out
                    bare = part[0] == ("sign", "[")
                    subject = self._node()[0]
                    if not (bare and self.at == len(part)):
                        self._pairs(subject)
                    if self.at < len(part):
                        raise ValueError(f"{part[self.at][1]!r} is too much")
            except (ValueError, IndexError) as e:
                yield None, None, None, None, None, None, f"{e}: {' '.join(t for _, t in part)[:200]}"
                continue
            yield from ((*t, None) for t in out)

    def _term(self, token: tuple[str, str]) -> tuple:
        kind, t = token
        if kind == "iri":
            iri = _unescaped(t[1:-1])
            return (iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri), "iri", None, None
        if kind == "name" and ":" in t:
            prefix, local = t.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"no prefix {prefix}:")
            return self.prefixes[prefix] + local, "iri", None, None
        if kind == "name" and t in ("true", "false"):
            return t, "literal", None, XSD + "boolean"
        if kind == "number":
            return t, "literal", None, XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer")
        if kind == "blank":
            return f"_:{self.mark}.{t[2:]}", "blank", None, None
        raise ValueError(f"{t!r} is no term")

    def _node(self) -> tuple:
        """A term, a text with its tag, a blank node with its own pairs, or a list."""
        kind, t = self.part[self.at]
        self.at += 1
        if kind == "text":
            quotes = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
            value, tag = _unescaped(t[quotes:-quotes]), self.part[self.at] if self.at < len(self.part) else ("", "")
            if tag[0] == "at":
                self.at += 1
                return value, "literal", tag[1][1:].lower(), None
            if tag[0] == "type":
                self.at += 2
                return value, "literal", None, self._term(self.part[self.at - 1])[0]
            return value, "literal", None, XSD + "string"
        if (kind, t) == ("sign", "["):
            self.blanks += 1
            node = f"_:{self.mark}[{self.blanks}]"
            if self.part[self.at] != ("sign", "]"):
                self._pairs(node)
            if self.part[self.at] != ("sign", "]"):
                raise ValueError("a blank node is not closed")
            self.at += 1
            return node, "blank", None, None
        if (kind, t) == ("sign", "("):
            members = []
            while self.part[self.at] != ("sign", ")"):
                members.append(self._node())
            self.at += 1
            rest = (RDF + "nil", "iri", None, None)
            for m in reversed(members):
                self.blanks += 1
                cell = f"_:{self.mark}({self.blanks})"
                self.out += [(cell, RDF + "first", *m), (cell, RDF + "rest", *rest)]
                rest = (cell, "blank", None, None)
            return rest
        return self._term((kind, t))

    def _pairs(self, subject: str) -> None:
        while True:
            token = self.part[self.at]
            self.at += 1
            p = RDF + "type" if token == ("name", "a") else self._term(token)[0]
            while True:
                self.out.append((subject, p, *self._node()))
                if self.at < len(self.part) and self.part[self.at] == ("sign", ","):
                    self.at += 1
                    continue
                break
            if not (self.at < len(self.part) and self.part[self.at] == ("sign", ";")):
                return
            while self.at < len(self.part) and self.part[self.at] == ("sign", ";"):
                self.at += 1
            if self.at == len(self.part) or self.part[self.at] == ("sign", "]"):
                return


def parse(texts: DataFrame) -> DataFrame:
    """TRIPLE of texts (mark, value): one row a triple, and one with error for a statement that is none.

    Statements end with a full stop; a wrong one is left out as a whole and the next one is read. Blank
    nodes are named by their text's mark and number, lists are chains of first and rest, and names
    are full addresses. A text is one row, so a file is what one task reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in TRIPLE.split(", ")]
        for b in batches:
            for k in range(len(b)):
                found = Statements(b.column(1)[k].as_py() or "", b.column(0)[k].as_py()).rows()
                while rows := list(islice(found, SLICE)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(len(names))], names)

    return texts.select("mark", "value").mapInArrow(run, TRIPLE)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of Turtle files."""
    files = spark.read.text(path, wholetext=True).select(F.md5(F.input_file_name()).alias("mark"), "value")
    return parse(files)


def match(t: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """One row for each way in which all patterns (s, p, o) hold: a column for each name that begins with a question mark.

    Patterns are joined on the names that they share with those before; what has no question mark is compared as it is.
    """
    out = None
    for pattern in patterns:
        part, cols = t.filter("error IS NULL"), {}
        for place, want in zip(("s", "p", "o"), pattern, strict=True):
            if not want.startswith("?"):
                part = part.filter(F.col(place) == want)
            elif want[1:] in cols:
                part = part.filter(F.col(place) == F.col(cols[want[1:]]))
            else:
                cols[want[1:]] = place
        part = part.select(*[F.col(c).alias(name) for name, c in cols.items()]).distinct()
        if out is None:
            out = part
        else:
            shared = [c for c in part.columns if c in out.columns]
            if not shared:
                raise ValueError("a pattern shares no name with those before it")
            out = out.join(part, shared)
    return out


def closure(pairs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """low, high: pairs (low, high) and all that chains of them connect; circles are allowed.

    Each round joins the paths found with one another, so a hierarchy of depth n takes log2(n) rounds.
    """
    paths = keep(pairs.select("low", "high").filter("low <> high").distinct(), "paths0")
    n, k = paths.count(), 0
    while True:
        longer = paths.select("low", F.col("high").alias("mid")).join(paths.select(F.col("low").alias("mid"), "high"), "mid").select("low", "high")
        k += 1
        paths = keep(paths.unionByName(longer).filter("low <> high").distinct(), f"paths{k}")
        n, before = paths.count(), n
        if n == before:
            return paths


def subclasses(t: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """low, high: every class with itself and all classes above it."""
    direct = match(t, ("?low", RDFS + "subClassOf", "?high"))
    classes = match(t, ("?low", RDF + "type", OWL + "Class")).unionByName(match(t, ("?low", RDF + "type", RDFS + "Class")))
    return closure(direct, keep).unionByName(classes.unionByName(direct.select("low")).unionByName(direct.select(F.col("high").alias("low"))).distinct().withColumn("high", F.col("low")))


def class_labels(t: DataFrame) -> DataFrame:
    """cls, label: every label of a class, in lower case."""
    return match(t, ("?cls", RDF + "type", OWL + "Class"), ("?cls", RDFS + "label", "?label")).select("cls", F.lower("label").alias("label")).distinct()


def checked_labels(t: DataFrame, labels: DataFrame) -> DataFrame:
    """label, valid: whether a class has the label, letters in either case."""
    known = class_labels(t).select(F.col("label").alias("_l")).distinct()
    return labels.select("label").distinct().join(known, F.lower("label") == F.col("_l"), "left").select("label", F.col("_l").isNotNull().alias("valid"))


def checked_edges(t: DataFrame, edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """src_label, rel_type, dst_label, edges, verdict of all kinds of edges by the properties' domains and ranges.

    A property is named by its label. An end fits if one of its classes, or a class above it, is in
    the domain (range); a property without one takes all. Unknown properties and classes are named so.
    """
    kinds = edges.groupBy("src_label", "rel_type", "dst_label").agg(F.count(F.lit(1)).alias("edges"))
    up = subclasses(t, keep).join(class_labels(t).withColumnRenamed("cls", "low"), "low").select("label", "high")
    ends = up.groupBy("label").agg(F.collect_set("high").alias("above"))  # as many as classes lie above one
    props = match(t, ("?prop", RDFS + "label", "?label")).select("prop", F.upper("label").alias("rel_type"))
    for name in ("domain", "range"):
        props = props.join(match(t, ("?prop", RDFS + name, f"?{name}")).groupBy("prop").agg(F.collect_set(name).alias(name)), "prop", "left")
    typed = match(t, ("?prop", RDF + "type", OWL + "ObjectProperty"))
    props = props.join(typed, "prop").drop("prop").dropDuplicates(["rel_type"])
    src, dst = ends.toDF("_src", "src_above"), ends.toDF("_dst", "dst_above")
    out = kinds.join(props, "rel_type", "left").join(src, F.lower("src_label") == F.col("_src"), "left").join(dst, F.lower("dst_label") == F.col("_dst"), "left")
    known = match(t, ("?prop", RDF + "type", OWL + "ObjectProperty"), ("?prop", RDFS + "label", "?label")).select(F.upper("label").alias("rel_type"), F.lit(True).alias("is_known")).distinct()
    fits = lambda have, want: F.col(want).isNull() | F.arrays_overlap(have, want)
    verdict = (
        F.when(F.col("is_known").isNull(), "unknown relationship").when(F.col("_src").isNull() | F.col("_dst").isNull(), "unknown label")
        .when(~fits("src_above", "domain"), "domain").when(~fits("dst_above", "range"), "range").otherwise("valid")
    )
    return out.join(known, "rel_type", "left").select("src_label", "rel_type", "dst_label", "edges", verdict.alias("verdict"))


# The relationships that are always valid, with what they connect.
STANDARD = {
    "MANUFACTURES": ("Brand", "Family"), "MANUFACTURES_ITEM": ("Brand", "Item"), "PRODUCED_BY": ("Item", "Brand"), "HAS_TIP": ("Product", "Insight"),
    "VARIANT_OF": ("Item", "Family"), "SIMILAR_TO": ("Product", "Product"), "BELONGS_TO": ("Item", "Category"),
}
_HEAD = f'@prefix : <http://example.com/o#> . @prefix rdfs: <{RDFS}> .\nPREFIX owl: <{OWL}>\n'


def land_ontology(g: Graph, path: str) -> None:
    """The graph's schema and places as Turtle: classes of nodes, relationships, regions above nations, brands in
    nations, and items with a weight (a blank node) and their numbers (a list)."""
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    schema = [f':{c} a owl:Class ; rdfs:label "{c}" ; rdfs:subClassOf :{up} .' for c, up in (("Item", "Product"), ("Family", "Product"), ("Product", "Node"), ("Brand", "Node"), ("Insight", "Node"), ("Source", "Node"), ("Node", "Node"))]
    schema += [f':{r} a owl:ObjectProperty ; rdfs:label "{r.lower()}" ; rdfs:domain :{a} ; rdfs:range :{b} .' for r, (a, b) in STANDARD.items()]
    schema += [':EXTRACTED_FROM a owl:ObjectProperty ; rdfs:label "EXTRACTED_FROM" .']
    n = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [
        g.spark.createDataFrame([(x,) for x in schema], "value string"),
        g.table("region").select(t(":r", F.col("r_regionkey"), " a owl:Class ;\n rdfs:label ", quoted(F.col("r_name")), " ; # a region\n .").alias("value")),
        n.select(t(":n", F.col("n_nationkey"), " a owl:Class ; rdfs:label ", quoted(F.col("n_name")), ", 'Land. ", F.lower("n_name"), "'@de ; rdfs:subClassOf :r", F.col("r_regionkey"), " .").alias("value")),
        g.table("supplier").select(t(":s", F.col("s_suppkey"), " a :n", F.col("s_nationkey"), " ; rdfs:label ", quoted(F.col("s_name")), " .").alias("value")),
        g.table("part").select(t(":i", F.col("p_partkey"), " a :Item ; rdfs:label ", quoted(F.col("p_name")), " ; :weight [ :grams ", F.col("p_size"), " ; :unit \"g\" ] ; :numbers ( ", F.col("p_partkey"), " ", F.col("p_size"), " \"x\" ) .").alias("value")),
    ]
    reduce(DataFrame.unionByName, parts).select(F.concat(F.lit(_HEAD), "value").alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(path)


def _ontology(g: Graph) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    path, keep = fresh_root(g.spark, "ontology"), keeper(g.spark)
    land_ontology(g, path)
    return keep(triples(g.spark, path), "triples"), keep


@query("ontology_instances", """SELECT r_name AS label, count(*) AS instances FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1
  UNION ALL SELECT n_name, count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 UNION ALL SELECT 'Item', count(*) FROM part UNION ALL SELECT 'Product', count(*) FROM part UNION ALL SELECT 'Node', count(*) FROM part""")
def ontology_instances(g: Graph) -> DataFrame:
    """How many nodes each class has, those of the classes below it included."""
    t, keep = _ontology(g)
    of = match(t, ("?x", RDF + "type", "?low"))
    label = t.filter(F.col("error").isNull() & (F.col("p") == RDFS + "label") & F.col("lang").isNull()).select(F.col("s").alias("high"), F.col("o").alias("label"))
    return of.join(subclasses(t, keep), "low").join(label, "high").groupBy("label").agg(F.countDistinct("x").alias("instances"))


@query("ontology_weights", """SELECT 'http://example.com/o#i' || p_partkey AS item, p_name AS label, CAST(p_size AS BIGINT) AS grams, 'g' AS unit, CAST(p_size AS VARCHAR) AS second FROM part""")
def ontology_weights(g: Graph) -> DataFrame:
    """Weights out of blank nodes, and the second members of lists."""
    t, _ = _ontology(g)
    ns = "http://example.com/o#"
    got = match(t, ("?item", ns + "weight", "?w"), ("?w", ns + "grams", "?grams"), ("?w", ns + "unit", "?unit"), ("?item", RDFS + "label", "?label"),
                ("?item", ns + "numbers", "?l"), ("?l", RDF + "rest", "?m"), ("?m", RDF + "first", "?second"))
    return got.select("item", "label", F.col("grams").cast("long").alias("grams"), "unit", "second")


@query("ontology_labels", """, x AS (SELECT DISTINCT name AS label FROM family UNION SELECT DISTINCT lower(term) FROM term UNION SELECT DISTINCT definition FROM term UNION SELECT DISTINCT dst_label FROM edges)
  SELECT label, lower(label) IN (SELECT lower(n_name) FROM nation UNION SELECT 'land. ' || lower(n_name) FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT unnest(['item', 'family', 'product', 'brand', 'insight', 'source', 'node'])) AS valid FROM x""")
def ontology_labels(g: Graph) -> DataFrame:
    """Whether names of families and terms, and labels of the graph, are classes of the ontology."""
    t, _ = _ontology(g)
    kinds = g.spark.createDataFrame(sorted({(e[1],) for e in EDGES.values()}), "label string")
    labels = g.family().select(F.col("name").alias("label")).unionByName(g.term().select(F.lower("term").alias("label"))).unionByName(g.term().select(F.col("definition").alias("label"))).unionByName(kinds)
    return checked_labels(t, labels)


@query("ontology_edges", """SELECT src_label, rel_type, dst_label, count(*) AS edges, CASE WHEN rel_type IN ('RELATES_TO', 'HAS_VARIANT', 'COMPARED_TO', 'PAIRS_WITH', 'USES_TERM') THEN 'unknown relationship'
  WHEN rel_type = 'PRODUCED_BY' AND src_label = 'Family' THEN 'domain' ELSE 'valid' END AS verdict FROM edges GROUP BY ALL""")
def ontology_edges(g: Graph) -> DataFrame:
    """All relationships of the graph by the domains and ranges of the ontology."""
    t, keep = _ontology(g)
    return checked_edges(t, g.edges(), keep)
