"""What selectors give where a page is parsed, against the same selectors as joins of a table of nodes."""

from cairn.operators import shop_pages
from cairn.sources import dom
from tests.test_dom import PAGE

SELECTORS = [
    "li", "ul > li > ul li", "#menu > li.a", ".a.y b, p", 'li[class*="x"]', '[data-k="v-1"] a', "[data-k^='v'] *", "a[href$='2']", "td", "tr", "body i", "nothing", "div", "title", "script", "a[href]",
    *shop_pages.CARDS, *shop_pages.CARD_NAMES, *shop_pages.BRANDS, *shop_pages.WEIGHTS, *shop_pages.TRAILS, shop_pages.BARE,
]
SHOP = '<body><div class="product-card x"><a href="/products/1">A<br>B</a><h3> C  D </h3><div class="product-card">in<p>ner</div></div><a href="/produkt/2" title=t></a></body>'


def test_finds_are_those_of_the_joins(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, SHOP), (3, None), (4, "")], "id long, html string")
    nodes = dom.nodes(pages, "id")
    nodes.cache()
    got = {r.id: [[(tuple(sorted(x.attrs.items())), x.inner) for x in hits] for hits in r.found] for r in dom.firsts(pages, "id", SELECTORS, k=100).collect()}
    for i, s in enumerate(SELECTORS):
        want = {}
        for r in dom.with_text(nodes, "id", dom.select(nodes, "id", s)).orderBy("id", "pre").collect():
            want.setdefault(r.id, []).append((tuple(sorted(r.attrs.items())), r.inner))
        assert {k: v[i] for k, v in got.items() if v[i]} == want, s
    assert got[3] == got[4] == [[] for _ in SELECTORS]


def test_finds_within_roots(spark):
    pages = spark.createDataFrame([(2, SHOP)], "id long, html string")
    rows = dom.firsts(pages, "id", ["a[href]", "p"], [".nothing", ".product-card"]).orderBy("root").collect()
    assert [(r.rank, r.pos, r.own["class"]) for r in rows] == [(1, 0, "product-card x"), (1, 1, "product-card")]
    assert [[[x.inner for x in hits] for hits in r.found] for r in rows] == [[["A\nB"], ["ner"]], [[], ["ner"]]]


def test_pages_of_one_file_are_dealt_to_many_tasks(spark):
    pages = spark.range(400).selectExpr("id", "'<p>x</p>' AS html").coalesce(1)
    assert dom.firsts(pages, "id", ["p"]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
