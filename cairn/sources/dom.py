"""Pages as a table of nodes: numbers in document order make selectors joins of ranges."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "pre int, last int, parent int, depth int, tag string, classes array<string>, attrs map<string,string>, lead string, text string"
# Elements without content, those that end open ones, and what they look past; those on lines of their own, those that
# end a paragraph, and where paragraphs are not looked for; those whose text is none.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
STOPS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
LINES = frozenset("address article aside blockquote body br div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
PARAGRAPH_ENDS = LINES - {"body", "br", "html", "li", "tr", "dt", "dd"}
SCOPES = frozenset("button caption html object table td template th".split())
SILENT = frozenset("script style noscript template head".split())


class _Tag:
    """A start tag as it is written: its attributes, the first of a name, and its classes."""

    def __init__(self, tag: str, attrs: list):
        self.tag, self.attrs = tag, attrs
        self.held = {n: v or "" for n, v in reversed(attrs)}
        self.names, self.values, self.classes = list(self.held), list(self.held.values()), self.held.get("class", "").split()
        self.plan, self.fits = None, []
        self.line, self.void, self.ends, self.stops, self.ends_paragraph = tag in LINES, tag in VOID, ENDS.get(tag), STOPS.get(tag, ()), tag in PARAGRAPH_ENDS

    def fitting(self, plan: _Plan) -> list[int]:
        """Numbers of the plan's compounds that the tag fits."""
        if self.plan is not plan:
            self.plan, self.fits = plan, [k for k, test in enumerate(plan.tests) if test(self.tag, self.classes, self.held)]
        return self.fits


class _One(HTMLParser):
    """Calls that one tag makes."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.calls: list[tuple] = []
        self.feed(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.calls.append((START, _Tag(tag, attrs)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.calls.append((BOTH, _Tag(tag, attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.calls.append((END, tag))


START, BOTH, END, HOLDER, SKIP, OTHER = range(6)
_SPACES, _BREAKS = re.compile(r"\s+"), re.compile(r" *\n *")
_PIECES = re.compile(r"<[^>]*>|[^<]+")
_STARTS = re.compile(r"""<[a-z][a-z0-9-]*(?:\s+[a-z_][a-z0-9_:.-]*(?:=(?:"[^"<>]*"|'[^'<>]*'))?)*\s*/?>""", re.I | re.A)
_ENDS = re.compile(r"</[a-z][a-z0-9-]*\s*>", re.I | re.A)
_SKIPPED = re.compile(r"<!doctype[^<>]*>|<!--(?:[^<>-]|-(?!-))+-->", re.I)
#: Characters of a tag that is known from then on at most.
KNOWN = 1024
#: Elements whose content is read in other ways, in one version of the parser or another; of some of them, text up to the end is read the same way.
RAW, PLAIN_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split()), frozenset("script style title".split())


@lru_cache(maxsize=1 << 15)
def _piece(text: str) -> tuple:
    """What the parser makes of one tag that means the same wherever it stands; OTHER if that may not be so."""
    if _SKIPPED.fullmatch(text):
        return (SKIP, None)
    if not _STARTS.fullmatch(text) and not _ENDS.fullmatch(text):
        return (OTHER, None)
    calls = _One(text).calls
    kind, what = calls[0] if len(calls) == 1 else (OTHER, None)
    if kind in (START, BOTH) and what.tag in RAW:
        return (HOLDER, what) if kind == START and what.tag in PLAIN_RAW else (OTHER, None)
    return (kind, what)


@lru_cache(maxsize=1 << 15)
def _tag(tag: str, attrs: tuple) -> _Tag:
    return _Tag(tag, list(attrs))


class _Page(HTMLParser):
    """The nodes of one page. Open elements are closed at the end; an end without a beginning is left out.

    Pages mostly hold the same tags over and over, so a tag is read once and known from then on. A page with anything that
    a tag alone does not tell (scripts with tags in them, open quotes, declarations) is read by the parser as a whole.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []  # parent, depth, tag, attributes, lead, text, last, the tag as written
        self.open: list[int] = []
        self.lead = ""

    def _close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            node = self.nodes[self.open.pop()]
            node[6] = len(self.nodes) - 1
            if node[2] in LINES:
                self.lead = "\n"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(_tag(tag, tuple(attrs)) if len(self.get_starttag_text() or "") <= KNOWN else _Tag(tag, attrs))

    def _start(self, written: _Tag) -> None:
        nodes, up = self.nodes, self.open
        if written.ends:
            for k in range(len(up) - 1, -1, -1):
                name = nodes[up[k]][2]
                if name in written.ends:
                    self._close(k)
                elif name in written.stops:
                    break
        if written.ends_paragraph:
            for k in range(len(up) - 1, -1, -1):
                name = nodes[up[k]][2]
                if name == "p":
                    self._close(k)
                if name == "p" or name in SCOPES:
                    break
        if written.line:
            self.lead = "\n"
        at = len(nodes)
        nodes.append([up[-1] if up else -1, len(up), written.tag, written.attrs, self.lead, None, at, written])
        if not written.void:
            up.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        nodes, up = self.nodes, self.open
        if up and nodes[up[-1]][2] == tag:  # as nearly always
            nodes[up.pop()][6] = len(nodes) - 1
            if tag in LINES:
                self.lead = "\n"
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][2] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            if any([self.nodes[k][2] in SILENT for k in self.open]) and self.nodes[self.open[-1]][2] != "title":
                return
            self.nodes.append([self.open[-1] if self.open else -1, len(self.open), "#text", [], self.lead, _SPACES.sub(" ", data), len(self.nodes), None])
            self.lead = ""

    def finish(self, html: str) -> list[list]:
        if not self._read(html):
            self.feed(html)
            self.close()
        self._close(0)
        return self.nodes

    def _read(self, html: str) -> bool:
        """Whether the page could be read by its pieces."""
        texts = _PIECES.findall(html)
        if len("".join(texts)) != len(html):
            return False
        for k, text in enumerate(texts):
            if text[0] != "<":
                self.handle_data(unescape(text) if "&" in text else text)
                continue
            kind, what = _piece(text) if len(text) <= KNOWN else (OTHER, None)
            if kind == START:
                self._start(what)
            elif kind == END:
                self.handle_endtag(what)
            elif kind == BOTH:
                self.handle_startendtag(what.tag, what.attrs)
            elif kind == HOLDER and self._ends_soon(what.tag, texts[k + 1 : k + 3]):
                self._start(what)
            elif kind != SKIP:
                self.nodes, self.open, self.lead = [], [], ""
                return False
        return True

    @staticmethod
    def _ends_soon(tag: str, some: list[str]) -> bool:
        """Whether an element whose start comes before holds text at most and is closed."""
        rest = some[1:] if some and some[0][0] != "<" else some
        return bool(rest) and len(rest[0]) <= KNOWN and _piece(rest[0]) == (END, tag)


def nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and NODE of every element and text of the pages; null and empty pages have none.

    pre counts nodes in document order, last is the pre of a node's last descendant: a node lies
    within another if its pre lies between. Text comes with runs of white space as one; lead is a
    line break if a block begins or ends before it. Scripts and styles have no text.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                found = _Page().finish(text) if text else []
                if not found:
                    continue
                cols = list(zip(*found, strict=True))
                attrs = [{n: v or "" for n, v in reversed(a)} for a in cols[3]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([k] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32()), pa.array(cols[6], pa.int32()), pa.array(cols[0], pa.int32()),
                     pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array([a.get("class", "").split() for a in attrs], pa.list_(pa.string())),
                     pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string())), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
                    [key, *[f.split()[0] for f in NODE.split(", ")]])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {NODE}")


_PART = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)["']?(?P<value>[^"'\]]*)["']?)?\]""")


def _fits(compound: str) -> Column:
    """Whether a node is what tag.class#id[attribute], in any mixture, says."""
    out = F.col("tag") != "#text"
    for m in _PART.finditer(compound):
        attr = F.col("attrs")[m["attr"] or "id"]
        if m["tag"] and m["tag"] != "*":
            out = out & (F.col("tag") == m["tag"].lower())
        elif m["cls"]:
            out = out & F.array_contains("classes", m["cls"])
        elif m["id"]:
            out = out & (attr == m["id"])
        elif m["attr"]:
            test = {None: lambda c, v: c.isNotNull(), "=": lambda c, v: c == v, "*=": F.contains, "^=": F.startswith, "$=": F.endswith}[m["op"]]
            out = out & test(attr, F.lit(m["value"]))
    return F.coalesce(out, F.lit(False))


def select(dom: DataFrame, key: str, selector: str) -> DataFrame:
    """The nodes of a selector: lists of compounds that lie within ("a b") or right below ("a > b") one another, with commas between."""
    found = []
    for one in selector.split(","):
        steps = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one)
        cur, child = None, False
        for step in steps:
            if step == ">":
                child = True
                continue
            part = dom.filter(_fits(step))
            if cur is not None:
                above = cur.select(F.col(key).alias("_k"), F.col("pre").alias("_pre"), F.col("last").alias("_last")).distinct()
                near = F.col("parent") == F.col("_pre") if child else (F.col("pre") > F.col("_pre")) & (F.col("pre") <= F.col("_last"))
                part = part.join(above, (F.col(key) == F.col("_k")) & near, "left_semi")
            cur, child = part, False
        found.append(cur)
    if len(found) == 1:
        return found[0]
    return reduce(DataFrame.unionByName, found).dropDuplicates([key, "pre"])


def with_text(dom: DataFrame, key: str, some: DataFrame) -> DataFrame:
    """some nodes with inner: all text in them in order, blocks on lines of their own, without blank ends."""
    texts = dom.filter("tag = '#text'").select(F.col(key).alias("_k"), F.col("pre").alias("_at"), F.concat("lead", "text").alias("_t"))
    near = (F.col(key) == F.col("_k")) & (F.col("_at") >= F.col("pre")) & (F.col("_at") <= F.col("last"))
    ids = some.select(key, "pre", "last").distinct()
    lists = ids.join(texts, near).groupBy(key, "pre").agg(F.sort_array(F.collect_list(F.struct("_at", "_t"))).alias("_l"))
    joined = F.regexp_replace(F.array_join(F.transform("_l", lambda x: x["_t"]), ""), r" *\n *", "\n")
    return some.join(lists.select(key, "pre", F.trim(F.regexp_replace(joined, r"^\s+|\s+$", "")).alias("inner")), [key, "pre"], "left").withColumn("inner", F.coalesce("inner", F.lit("")))


def first_of(dom: DataFrame, key: str, selectors: list[str], name: str, within: DataFrame | None = None, value: Column | None = None) -> DataFrame:
    """key, (root,) name: the text (or value) of the first selector's first node that has any, of a page or, with within
    (key, root, root_last), inside each of its nodes."""
    parts = [select(dom, key, s).select(key, "pre", "last", "attrs", F.lit(i).alias("rank")) for i, s in enumerate(selectors)]
    some = reduce(DataFrame.unionByName, parts)
    group = [key]
    if within is not None:
        roots = within.select(F.col(key).alias("_k"), "root", "root_last").distinct()
        some = some.join(roots, (F.col(key) == F.col("_k")) & (F.col("pre") > F.col("root")) & (F.col("pre") <= F.col("root_last"))).drop("_k", "root_last")
        group = [key, "root"]
    first = some.groupBy(*group, "rank").agg(F.min_by(F.struct("pre", "last", "attrs"), "pre").alias("x")).select(*group, "rank", "x.*")  # the first node of each selector alone
    held = with_text(dom, key, first) if value is None else first.withColumn("inner", value)
    return held.filter("inner <> ''").groupBy(*group).agg(F.min_by("inner", "rank").alias(name))


def _test_of(compound: str) -> Callable[[str, list[str], dict[str, str]], bool]:
    """_fits, for the tag, classes and attributes of one node."""
    tests = []
    for m in _PART.finditer(compound):
        if m["tag"] and m["tag"] != "*":
            tests.append(lambda tag, classes, attrs, v=m["tag"].lower(): tag == v)
        elif m["cls"]:
            tests.append(lambda tag, classes, attrs, v=m["cls"]: v in classes)
        elif m["id"]:
            tests.append(lambda tag, classes, attrs, v=m["id"]: attrs.get("id") == v)
        elif m["attr"]:
            op = {None: lambda c, v: True, "=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith}[m["op"]]
            tests.append(lambda tag, classes, attrs, n=m["attr"], op=op, v=m["value"]: n in attrs and op(attrs[n], v))
    return lambda tag, classes, attrs: tag != "#text" and all(t(tag, classes, attrs) for t in tests)


class _Plan:
    """Selectors as steps over numbered compounds: for each of a selector's lists, whether a step lies right below the one before, and its compound."""

    def __init__(self, selectors: list[str]):
        self.numbers: dict[str, int] = {}
        self.selectors = [self._steps(s) for s in selectors]
        self.tests = [_test_of(c) for c in self.numbers]

    def _steps(self, selector: str) -> list[list[tuple[bool, int]]]:
        out = []
        for one in selector.split(","):
            steps, child = [], False
            for step in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one):
                if step == ">":
                    child = True
                else:
                    steps.append((child, self.numbers.setdefault(step, len(self.numbers))))
                    child = False
            out.append(steps)
        return out


class _Found:
    """What a plan's selectors give on one page, by the same rules as select and with_text."""

    def __init__(self, html: str, plan: _Plan):
        self.nodes = _Page().finish(html)
        self.fits: list[list[int]] = [[] for _ in plan.tests]
        for k, x in enumerate(self.nodes):
            if x[7] is not None:
                for c in x[7].fitting(plan):
                    self.fits[c].append(k)

    def select(self, steps: list[list[tuple[bool, int]]]) -> list[int]:
        if len(steps) == 1 and len(steps[0]) == 1:
            return self.fits[steps[0][0][1]]
        every: set[int] = set()
        for one in steps:
            cur: set[int] | None = None
            for child, what in one:
                cur = set(self.fits[what]) if cur is None else {k for k in self.fits[what] if self._below(k, cur, child)}
            every |= cur or set()
        return sorted(every)

    def _below(self, k: int, above: set[int], child: bool) -> bool:
        up = self.nodes[k][0]
        while up >= 0 and up not in above and not child:
            up = self.nodes[up][0]
        return up in above

    def inner(self, k: int) -> str:
        last = self.nodes[k][6]
        if last == k:
            return ""
        text = "".join([x[4] + x[5] for x in self.nodes[k : last + 1] if x[7] is None])
        return _BREAKS.sub("\n", text).strip(" \t\n\r\f\v") if text else ""


class _Maps:
    """Attributes of tags as a column of maps."""

    def __init__(self):
        self.names: list[str] = []
        self.values: list[str] = []
        self.ends = [0]

    def add(self, written: _Tag) -> None:
        self.names += written.names
        self.values += written.values
        self.ends.append(len(self.names))

    def column(self) -> pa.Array:
        return pa.MapArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))


FOUND = "own map<string,string>, own_text string, found array<array<struct<attrs:map<string,string>,inner:string>>>"


def firsts(pages: DataFrame, key: str, selectors: list[str], roots: list[str] | None = None, k: int = 1, html: str = "html", *, deal: bool = True) -> DataFrame:
    """key, rank, pos, root, own, own_text, found: for each page, or each node of each of the roots' selectors on it, the first k
    nodes inside it that each selector gives, with their attributes and texts.

    rank is the root's selector, pos its place among the nodes of it, own and own_text are its attributes and text; of whole pages
    they are 0, 0, -1 and nulls. Pages are dealt to as many tasks as a shuffle has, whatever files they come from, unless deal is
    False, for pages that an exchange by their key has made; what a page gives is worked out where it is parsed: nodes are neither stored nor joined.
    """
    kind = pages.schema[key].dataType.simpleString()

    names = [key, "rank", "pos", "root", "own", "own_text", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _Plan([*selectors, *(roots or [])])
        asked, around = plan.selectors[: len(selectors)], plan.selectors[len(selectors) :]
        for b in batches:
            for start in range(0, len(b), 256):
                part = b.slice(start, 256)
                rows, own, own_text, attrs, inner, each, every = [], _Maps(), [], _Maps(), [], [0], [0]
                for at, text in enumerate(part.column(1).to_pylist()):
                    page = _Found(text or "", plan)
                    hits = [page.select(s) for s in asked]
                    places = [(0, 0, -1)] if roots is None else [(rank, pos, n) for rank, steps in enumerate(around) for pos, n in enumerate(page.select(steps))]
                    for rank, pos, root in places:
                        rows.append((at, rank, pos, root))
                        last = len(page.nodes)
                        if root >= 0:
                            last = page.nodes[root][6]
                            own.add(page.nodes[root][7])
                            own_text.append(page.inner(root))
                        for h in hits:
                            if h:
                                low = bisect_right(h, root)
                                for n in h[low : min(bisect_right(h, last, low), low + k)]:
                                    attrs.add(page.nodes[n][7])
                                    inner.append(page.inner(n))
                            each.append(len(inner))
                        every.append(len(each) - 1)
                if rows:
                    cols = list(zip(*rows, strict=True))
                    some = pa.StructArray.from_arrays([attrs.column(), pa.array(inner, pa.string())], ["attrs", "inner"])
                    found = pa.ListArray.from_arrays(pa.array(every, pa.int32()), pa.ListArray.from_arrays(pa.array(each, pa.int32()), some))
                    mine = [pa.nulls(len(rows), pa.map_(pa.string(), pa.string())), pa.nulls(len(rows), pa.string())] if roots is None else [own.column(), pa.array(own_text, pa.string())]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int32()) for c in cols[1:]], *mine, found], names)

    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.select(key, html)
    return (dealt.repartition(n, key) if deal else dealt).mapInArrow(run, f"`{key}` {kind}, rank int, pos int, root int, {FOUND}")


def first_text(places: list[int]) -> Column:
    """The text of the first of the selectors (by number) whose first node has any."""
    each = [F.get(F.get("found", F.lit(i)), F.lit(0))["inner"] for i in places]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in each])


def joined_url(base: Column, href: Column) -> Column:
    """The address that a link on a page means."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/])/[^/]*$", "")
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(folder, F.lit("/"), href))
    )
    for _ in range(4):  # steps up that are followed
        whole = F.regexp_replace(F.regexp_replace(whole, r"(?<=[^/])/\./", "/"), r"(?<=[^/:])/(?!\.\./)[^/?#]+/\.\./", "/")
    return whole


def rank_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") == 1).drop("_r")
