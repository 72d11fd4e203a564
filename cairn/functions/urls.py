"""URL kernels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of product and of collection addresses, and of those that are neither.
PRODUCT_PATHS = [r"/products?/", r"/produkte?/", r"/productos?/", r"/produits?/", "/p/", "/item/", "/gear/", "/shop/", "/store/", "/buy/", "/catalog/", "/artikel/"]
COLLECTION_PATHS = [
    r"/collections?/[^/]+", r"/categories?/[^/]+", r"/category/[^/]+", r"/kategorien?/[^/]+", r"/categorias?/[^/]+", r"/categorie[s]?/[^/]+",
    r"/c/[^/]+", r"/shop/[^/]+", r"/product-category/[^/]+",
]
SKIPPED = [
    "/cart", "/checkout", "/account", "/login", "/register", "/about", "/contact", "/faq", "/help", "/support", "/privacy", "/terms", "/shipping", "/returns",
    "/blog", "/news", "/press", "/careers", ".pdf", ".jpg", ".png", ".gif", "/sitemap", ".xml", "/pages/",
]
LOCALE = r"^/(en-ca|fr-ca|en-gb|en-us|de-de|es-es|fr|en|de|es)/"


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def matches(c: Column, patterns: list[str]) -> Column:
    return F.lower(c).rlike("|".join(f"(?:{p})" for p in patterns))


def is_product(url: Column) -> Column:
    return matches(url, PRODUCT_PATHS)


def is_collection(url: Column) -> Column:
    return matches(url, COLLECTION_PATHS)


def is_skipped(url: Column) -> Column:
    low = F.lower(url)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in SKIPPED])


def without_locale(p: Column) -> Column:
    return F.regexp_replace(F.lower(p), LOCALE, "/")


def video_id(url: Column) -> Column:
    """The id of a video address of any of the usual forms; null without one."""
    forms = [r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/(?:embed|shorts|live)/([A-Za-z0-9_-]{11})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(url, f, 1), F.lit("")) for f in forms])


def thumbnail(url: Column) -> Column:
    return F.concat(F.lit("https://img.youtube.com/vi/"), video_id(url), F.lit("/maxresdefault.jpg"))


def playlist_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]list=([a-zA-Z0-9_-]+)", 1), F.lit(""))


def category_name(p: Column) -> Column:
    """The last part of a path as words."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    return F.initcap(F.regexp_replace(last, "[-_]", " "))


def links_in(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))
