"""What shop pages hold: product cards of a collection, a reseller's product, the items of a pack list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.mutations import upsert
from cairn.operators.upserts import NOW
from cairn.registry import query
from cairn.sources.dom import first_text, firsts, joined_url, nodes, rank_first, select, with_text
from cairn.sources.scratch import keeper
from cairn.sources.views import Graph

# Where pages of shops have their parts, in the order in which they are looked at.
CARDS = [
    ".product-card", ".product-item", ".product-grid-item", "[data-product-id]", ".grid__item .card", ".product", ".product-tile", 'a[href*="/products/"]', 'a[href*="/product/"]',
    'a[href*="/produkt/"]', 'a[href*="/produkte/"]', ".woocommerce-loop-product__link", ".woocommerce-LoopProduct-link",
]
CARD_NAMES = [
    ".product-card__title", ".product-item__title", ".product__title", ".card__heading", ".product-title", ".product-name", "[data-product-title]",
    ".woocommerce-loop-product__title", ".wc-block-grid__product-title", "h2", "h3",
]
CARD_PRICES = [".price", ".product-price", ".money", "[data-price]", ".amount", ".woocommerce-Price-amount"]
BARE = 'a[href*="/product"], a[href*="/produkt"]'
PRODUCT_PATHS = ["/product/", "/products/", "/produkt/", "/produkte/", "/artikel/"]
OTHER_PATHS = [
    "/faq", "/terms", "/privacy", "/policy", "/policies", "/shipping", "/returns", "/contact", "/about", "/payment", "/pricing", "/production-time", "/company", "/legal", "/impressum", "/agb",
    "/customers-outside", "/free-shipping", "/cart", "/checkout", "/account", "/login", "/register", "/blog", "/news", "/press",
]
TITLES = [".product_title", "h1.entry-title", "h1", ".product-title"]
BRANDS = [".product_meta .brand a", '[class*="brand"]', ".woocommerce-product-attributes-item--brand .woocommerce-product-attributes-item__value", ".brand-name", '[itemprop="brand"]']
PRICES = [".price", ".woocommerce-Price-amount", "[itemprop='price']"]
TEXTS = [".woocommerce-product-details__short-description", ".product-description", "#tab-description"]
WEIGHTS = [".product_weight", '[class*="weight"]', ".woocommerce-product-attributes-item--weight"]
TRAILS = [".woocommerce-breadcrumb, .breadcrumb"]
GRAMS = {"kg": 1000.0, "oz": 28.35, "lb": 453.59}


def is_product_url(url: Column) -> Column:
    path = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    has = lambda parts: reduce(Column.__or__, [F.contains(path, F.lit(p)) for p in parts])
    return ~has(OTHER_PATHS) & has(PRODUCT_PATHS)


def cards(pages: DataFrame, key: str, keep=None) -> DataFrame:
    """key, url, name, price: the products of each collection page (key, url, html), once each address.

    The first of CARDS with a product on the page counts; a card's product is its first link, or the
    card itself. A page without any gives its product links, with their texts or titles as names.
    """
    places = ["a[href]", *CARD_NAMES, *CARD_PRICES]
    names = range(1, 1 + len(CARD_NAMES))
    prices = range(1 + len(CARD_NAMES), len(places))
    href = F.coalesce(F.nullif(F.get(F.get("found", F.lit(0)), F.lit(0))["attrs"]["href"], F.lit("")), F.col("own")["href"])
    line = lambda c: F.split(c, "\n")[0]
    found = firsts(pages, key, places, [*CARDS, BARE])
    card = F.col("rank") < len(CARDS)
    title = F.substring(F.trim(F.coalesce(first_text(names), line(F.col("own_text")))), 1, 200)
    label = F.trim(line(F.when(F.col("own_text") != "", F.col("own_text")).otherwise(F.col("own")["title"])))
    rows = found.select(key, "rank", "root", F.when(card, href).otherwise(F.col("own")["href"]).alias("href"), F.when(card, title).otherwise(label).alias("name"), F.when(card, first_text(prices)).alias("price"))
    skipped = F.contains("href", F.lit("#")) | F.lower("href").rlike("javascript:|mailto:")
    good = F.when(card, F.col("name") != "").otherwise(~skipped & (F.length("name") > 2) & (F.length("name") < 200))
    rows = rows.filter(is_product_url(F.col("href")) & good).join(pages.select(key, F.col("url").alias("page_url")), key)
    rows = rows.select(key, "rank", "root", joined_url(F.col("page_url"), F.col("href")).alias("url"), "name", "price")
    chosen = rows.withColumn("_least", F.min("rank").over(Window.partitionBy(key))).filter("rank = _least")  # the links of one page
    return rank_first(chosen, [key, "url"], ["root"]).select(key, "url", "name", "price")


def grams_of(text: Column, pattern: str) -> Column:
    """The first weight of a pattern (number, unit) in whole grams."""
    low = F.lower(text)
    value = F.regexp_replace(F.regexp_extract(low, pattern, 1), ",", ".").try_cast("double")
    unit = F.regexp_extract(low, pattern, 2)
    factor = F.coalesce(*[F.when(unit == u, f) for u, f in GRAMS.items()], F.lit(1.0))
    return F.floor(value * factor).cast("int")


def reseller_products(pages: DataFrame, key: str, keep=None) -> DataFrame:
    """key, name, brand, price, category, description, weight_grams of each product page (key, html) of a shop with several brands.

    Each field is the text of the first of its places that has any. Without a brand, "Brand - Name" is
    split. The weight comes from its own place, or from "weight" or "Gewicht" in the page's text; the category
    is the last step of the trail, or the one before if that is the name's first word.
    """
    fields, places, at = {}, [], {}
    for column, some in (("name", TITLES), ("brand", BRANDS), ("price", PRICES), ("description", TEXTS), ("trail", TRAILS), ("weight", WEIGHTS), ("body", ["body"])):
        at[column] = range(len(places), len(places) + len(some))
        places += some
    for column in ("name", "brand", "price", "description", "trail"):
        fields[column] = first_text(at[column])
    own = r"(\d+(?:[.,]\d+)?)\s*(g|kg|oz|lb)"
    fields["placed"] = F.coalesce(*[grams_of(first_text([i]), own) for i in at["weight"]])
    fields["said"] = F.coalesce(
        grams_of(first_text(at["body"]), r"gewicht[:\s]*(\d+(?:[.,]\d+)?)\s*(g|kg)"), grams_of(first_text(at["body"]), r"weight[:\s]*(\d+(?:[.,]\d+)?)\s*(g|kg|oz)"))
    out = firsts(pages, key, places).select(key, *[c.alias(n) for n, c in fields.items()])
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parts = F.split("name", " - ")
    two = F.col("brand").isNull() & (F.size(parts) == 2)
    title = F.when(two, F.trim(parts[1])).otherwise(text("name"))
    steps = F.filter(F.transform(F.split("trail", "/"), lambda s: F.trim(s)), lambda s: s != "")
    last = F.element_at(steps, -1)
    category = F.when(F.size(steps) > 1, F.when(last == F.split(title, " ")[0], F.element_at(steps, -2)).otherwise(last)).otherwise(text("trail"))
    return out.select(
        key, title.alias("name"), F.when(two, F.trim(parts[0])).otherwise(text("brand")).alias("brand"), text("price").alias("price"), F.coalesce(category, F.lit("")).alias("category"),
        F.trim(F.substring(text("description"), 1, 500)).alias("description"), F.coalesce("placed", "said").alias("weight_grams"),
    )


def pack_items(pages: DataFrame, key: str, keep=None, *, deal: bool = True) -> DataFrame:
    """key, pos, name, weight_grams, price, is_worn, is_consumable of each item of a pack list page (key, html); items without a name are left out.

    deal as in firsts."""
    found = firsts(pages, key, [".lpDescription", "input[type='text']", "input.lpNumber", ".lpWorn.lpActive", ".lpConsumable.lpActive"], [".lpItem"], k=2, deal=deal)
    first = lambda i, n=0: F.get(F.get("found", F.lit(i)), F.lit(n))
    called = F.coalesce(first(0), first(1))
    name = F.coalesce(F.nullif(called["attrs"]["value"], F.lit("")), called["inner"])
    w = F.lower(F.replace(F.coalesce(first(2)["attrs"]["value"], F.lit("")), F.lit(","), F.lit("")))
    value = F.regexp_extract(w, r"([\d.]+)", 1).try_cast("double")
    grams = F.floor(F.when(F.contains(w, F.lit("kg")), value * 1000).when(F.contains(w, F.lit("lb")), value * 453.592).when(F.contains(w, F.lit("oz")), value * 28.3495).otherwise(value))
    return found.select(
        key, "pos", F.trim(name).alias("name"), grams.cast("int").alias("weight_grams"), F.nullif(F.trim(first(2, 1)["attrs"]["value"]), F.lit("")).alias("price"),
        first(3).isNotNull().alias("is_worn"), first(4).isNotNull().alias("is_consumable"),
    ).filter("name <> ''")


def _html(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _t(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def collection_pages(g: Graph) -> DataFrame:
    """Pages of twenty parts each, written as three kinds of shops write them: cards in a grid, a list of links with headings, bare links."""
    p = g.table("part").withColumn("shop_page", F.floor(F.col("p_partkey") / 20).cast("long"))
    k, name, price = F.col("p_partkey").cast("string"), _html("p_name"), F.col("p_retailprice").cast("string")
    card = _t('<div class="grid product-card big"><a href="/products/', k, '?v=1"><img src="x.png"></a><span class="badge">New</span>\n <h3 class="product-card__title">', name, ' &amp; co</h3><p><span class="price">$', price, "</span></div>")
    entry = _t('<li class="product"><a class="woocommerce-loop-product__link" href="https://other.example.org/produkt/', k, '"><h2> ', name, '\n</h2></a><a href="/cart?add=', k, '">Add</a><span class="amount"><b>', price, "</b> EUR</span>")
    bare = _t('<tr><td><a title="T', k, '" href="../product/', k, '">', name, '<br>more</a><td><a href="/blog/product/', k, '">news</a><td><a href="#product">top</a>')
    pages = p.groupBy("shop_page").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", x.alias("x")))), lambda s: s["x"]), "\n").alias(n) for n, x in (("card", card), ("entry", entry), ("bare", bare))])  # twenty rows each
    kind = F.col("shop_page") % 3
    body = F.when(kind == 0, _t("<main>", F.col("card"), "</main>")).when(kind == 1, _t("<ul class='products'>", F.col("entry"), "</ul>")).otherwise(_t("<table>", F.col("bare"), "</table>"))
    html = _t('<!DOCTYPE html><html><head><title>Shop</title><script>var a = "<div class=product-card>";</script><style>.price{}</style></head><body><nav><a href="/collections/all">All</a></nav><!-- <div class="product-card"> -->', body, "</body></html>")
    return pages.select("shop_page", _t("https://shop.example.com/c/all/", F.col("shop_page").cast("string")).alias("url"), html.alias("html"))


def product_pages(g: Graph) -> DataFrame:
    """One page a part, as different shops write them: brand in a place of its own or in the title, weight in a table, a sentence or nowhere."""
    p = g.table("part")
    kind = F.col("p_partkey")
    name, brand, size, price = _html("p_name"), _html("p_brand"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    title = F.when(kind % 3 == 0, _t('<h1 class="entry-title">', brand, " - ", name, "</h1>")).otherwise(_t('<h1>Shop</h1><div class="product_title">', name, "</div>"))
    maker = F.when(kind % 3 == 1, _t('<div class="product_meta"><span class="brand">by <a href="/b">', brand, "</a></span></div>")).when(kind % 3 == 2, _t('<span itemprop="brand"> ', brand, " </span>")).otherwise(F.lit(""))
    weight = F.when(kind % 4 == 0, _t('<table><tr class="woocommerce-product-attributes-item--weight"><th>Weight<td>', size, ",5 kg</table>")).when(kind % 4 == 1, _t("<p>Gewicht: ", size, " g</p>")).when(kind % 4 == 2, _t("<p>The weight <b>", size, "</b> oz</p>")).otherwise(F.lit(""))
    trail = _t('<nav class="breadcrumb">Home / ', _html("p_type"), F.when(F.floor(kind / 12) % 2 == 0, _t(" / ", F.split(name, " ")[0])).otherwise(F.lit("")), "</nav>")
    html = _t("<html><body><script>weight: 99 g</script>", trail, title, maker, '<p class="price">', price, " &euro;</p>", weight, '<div class="product-description">A ', name, "<p>for all</div></body></html>")
    return p.select("p_partkey", html.alias("html"))


def pack_pages(g: Graph) -> DataFrame:
    """One pack list an order: its lines as items with inputs. Lines are exchanged by order, their pages made after that."""
    parts = g.table("part").select("p_partkey", _html("p_name").alias("name"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size"))
    line = g.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("l_quantity").cast("int").alias("quantity")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    unit = lambda n: F.element_at(F.array(*[F.lit(u) for u in ("", " g", " oz", "lb", " kg")]), (n % 5 + 1).cast("int"))
    active = lambda c: F.when(c, " lpActive").otherwise("")
    item = lambda x: _t('<li class="lpItem" id="', x["l_linenumber"].cast("string"), '"><input type="text" class="lpName" value="', x["name"], '"><i class="lpWorn', active(x["l_returnflag"] == "R"), '"></i><i class="lpConsumable', active(x["l_returnflag"] == "A"),
                        '"></i><input class="lpNumber" value="1,', x["size"], unit(x["l_linenumber"]), '"><input class="lpNumber" value="', x["quantity"].cast("string"), '"></li>')
    tasks = int(g.spark.conf.get("spark.sql.shuffle.partitions"))  # short lines are long pages: a given number is not made smaller
    lists = line.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "name", "size", "l_returnflag", "quantity"))).alias("lines"))  # the lines of one order
    return lists.select("l_orderkey", _t("<html><head><title>Pack</title></head><body><ul>", F.array_join(F.transform("lines", item), ""), "</ul></body></html>").alias("html"))


@query("page_links", r"""SELECT page_id, i - 1 AS pos, replace(h[i], '&amp;', '&') AS href, trim(replace(replace(replace(replace(replace(t[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')) AS label FROM (
  SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2) AS t, unnest(range(1, len(regexp_extract_all(nav, '<a href="([^"]*)">')) + 1)) AS i FROM (
    SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages))""")
def page_links(g: Graph) -> DataFrame:
    """The links of each page's navigation in order, with their texts."""
    dom = keeper(g.spark)(nodes(g.table("pages"), "page_id"), "dom")
    links = with_text(dom, "page_id", select(dom, "page_id", "nav li > a[href]"))
    place = links.groupBy("page_id").agg(F.array_sort(F.collect_list("pre")).alias("all"))  # the links of one page
    return links.join(place, "page_id").select("page_id", (F.array_position("all", F.col("pre")) - 1).alias("pos"), F.col("attrs")["href"].alias("href"), F.col("inner").alias("label"))


@query("page_cards", """SELECT p_partkey // 20 AS shop_page, CASE (p_partkey // 20) % 3 WHEN 0 THEN 'https://shop.example.com/products/' || p_partkey || '?v=1' WHEN 1 THEN 'https://other.example.org/produkt/' || p_partkey
    ELSE 'https://shop.example.com/c/product/' || p_partkey END AS url, CASE (p_partkey // 20) % 3 WHEN 0 THEN p_name || ' & co' ELSE p_name END AS name,
    CASE (p_partkey // 20) % 3 WHEN 0 THEN '$' || p_retailprice WHEN 1 THEN p_retailprice || ' EUR' END AS price FROM part""")
def page_cards(g: Graph) -> DataFrame:
    """The products of all collection pages."""
    return cards(collection_pages(g), "shop_page")


@query("research_reseller", """SELECT p_partkey, p_name AS name, p_brand AS brand, p_retailprice || ' €' AS price, p_type AS category, 'A ' || p_name || chr(10) || 'for all' AS description,
  CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size WHEN 2 THEN floor(p_size * 28.35::DOUBLE) END AS INTEGER) AS weight_grams FROM part""")
def research_reseller(g: Graph) -> DataFrame:
    """The product of each page of a shop with several brands."""
    return reseller_products(product_pages(g), "p_partkey")


@query("files_pack_items", """SELECT l_orderkey, p_name AS name,
  CAST(floor((1000 + p_size) * CASE l_linenumber % 5 WHEN 2 THEN 28.3495::DOUBLE WHEN 3 THEN 453.592::DOUBLE WHEN 4 THEN 1000 ELSE 1 END) AS INTEGER) AS weight_grams, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS price,
  l_returnflag = 'R' AS is_worn, l_returnflag = 'A' AS is_consumable FROM lineitem JOIN part ON p_partkey = l_partkey""")
def files_pack_items(g: Graph) -> DataFrame:
    """The items of all pack lists."""
    return pack_items(pack_pages(g), "l_orderkey", deal=False).drop("pos")


def enriched(items: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """items (node_id, weight_grams) with the weights that were found for those that lack one, and when; others stay."""
    missing = found.filter("weight_grams > 0").join(items.filter("weight_grams IS NULL").select("node_id"), "node_id", "left_semi")
    done = upsert(items, missing.select("node_id", "weight_grams"), ["node_id"])
    return done.select("node_id", "weight_grams", F.when(F.col("action") == "updated", now).alias("enriched_at"))


@query("mut_enrich_write_back", f"""SELECT node_id, coalesce(weight_grams, w) AS weight_grams, CASE WHEN weight_grams IS NULL AND w > 0 THEN '{NOW}' END AS enriched_at FROM item JOIN (SELECT p_partkey,
  CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 + 500 WHEN 1 THEN p_size WHEN 2 THEN floor(p_size * 28.35::DOUBLE) END AS INTEGER) AS w FROM part) ON p_partkey = node_id""")
def mut_enrich_write_back(g: Graph) -> DataFrame:
    """Weights read from the product pages of items that lack one are written back, with the time."""
    items = g.item().select("node_id", F.col("weight_grams").cast("int").alias("weight_grams"))
    found = reseller_products(product_pages(g), "p_partkey").withColumnRenamed("p_partkey", "node_id")
    return enriched(items, found, NOW)


@query("page_list_quality", """SELECT p_partkey // 20 AS shop_page, count(*) AS products, count(*) AS with_price, count(*) FILTER (p_partkey % 4 <> 3) AS with_weight, count(*) AS with_description FROM part GROUP BY 1""")
def page_list_quality(g: Graph) -> DataFrame:
    """How many of the products that a list page leads to have a weight, a price and a description."""
    rows = reseller_products(product_pages(g), "p_partkey").withColumn("shop_page", F.floor(F.col("p_partkey") / 20).cast("long"))
    has = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return rows.groupBy("shop_page").agg(F.count(F.lit(1)).alias("products"), has("price").alias("with_price"), has("weight_grams").alias("with_weight"), has("description").alias("with_description"))
