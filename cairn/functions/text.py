"""Text kernels as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.operators import rules

#: Words that do not count as tokens of a name.
STOP_WORDS = ["the", "a", "an", "and", "or", "for", "with", "ultra", "light", "lightweight", "ultralight", "pro", "plus", "new"]
#: Variant patterns in order; the first that matches decides.
VARIANT_PATTERNS = [
    (r"^(.+?)\s+(\d{1,2})(\+)?$", "version_number"),
    (r"(?i)^(.+?)\s+(\d{2,3})([L]?)$", "size_number"),
    (r"(?i)^(.+?)\s+(\d+g)$", "weight_spec"),
    (r"^(.+?)\s+(\d+°[FC]?)$", "temperature"),
    (r"(?i)^(.+?)\s+(\d{3,4}\s*Fill.*)$", "fill_power"),
    (r"^(.+?)\s+(\d)\s+(GTX|Pro|Plus|Ultra)$", "model_suffix"),
]
#: Keywords by category, tested in this order.
CATEGORY_KEYWORDS = {
    "stove": ["stove", "burner", "canister", "fuel", "cooking system", "jetboil", "msr", "brs", "pocket rocket", "windburner", "alcohol stove", "esbit", "white gas", "isobutane"],
    "tent": ["tent", "shelter", "tarp", "bivy", "bivouac", "vestibule", "fly", "footprint", "groundsheet", "stakes", "guylines", "freestanding", "non-freestanding", "inner tent"],
    "sleeping_bag": ["sleeping bag", "quilt", "down bag", "synthetic bag", "mummy bag", "temperature rating", "fill power", "draft collar", "footbox", "sleeping system"],
    "sleeping_pad": ["sleeping pad", "mattress", "inflatable pad", "foam pad", "r-value", "thermarest", "neoair", "zlite", "ccf pad"],
    "backpack": ["backpack", "pack", "rucksack", "daypack", "frameless", "frame", "hip belt", "load lifter", "shoulder strap", "pack volume", "liters", "ultralight pack"],
    "water_filter": ["water filter", "filtration", "purification", "sawyer", "katadyn", "befree", "squeeze", "gravity filter", "water treatment", "aquamira", "chlorine dioxide"],
    "clothing": ["jacket", "pants", "shirt", "layer", "base layer", "mid layer", "insulation", "rain gear", "windshirt", "puffy", "down jacket", "fleece", "merino", "softshell"],
    "footwear": ["shoes", "boots", "trail runner", "hiking boot", "sandals", "camp shoes", "socks", "gaiters", "insoles"],
    "cookware": ["pot", "pan", "mug", "spork", "utensil", "bowl", "titanium pot", "cook kit", "lid", "windscreen"],
    "lighting": ["headlamp", "flashlight", "lantern", "lumens", "nitecore", "petzl", "black diamond"],
    "navigation": ["compass", "gps", "map", "navigation", "garmin", "inreach"],
    "trekking_poles": ["trekking pole", "hiking pole", "walking stick", "carbon pole", "aluminum pole", "pole tip"],
    "electronics": ["battery", "power bank", "solar panel", "charger", "usb", "phone", "camera", "satellite communicator"],
}
#: Patterns of demanding and of simple prompts.
HARD_PROMPTS = [
    r"verify|verification|validate|fact.?check", r"conflict|discrepancy|contradiction", r"compare.*multiple|analyze.*depth|comprehensive",
    r"why.*different|explain.*difference", r"reconcile|resolve.*issue", r"complex|difficult|challenging",
]
EASY_PROMPTS = [
    r"^(what|who|where|when|which)\s+is\b", r"^(list|show|get|find)\s+(me\s+)?(the\s+)?", r"how\s+much\s+(does|is)", r"^(yes|no)\?",
    r"search\s+(for|the)\s+graph", r"graph\s+stats|statistics",
]
#: Materials looked for in texts.
MATERIALS = ["dyneema", "silnylon", "silpoly", "titanium", "aluminum", "nylon", "polyester", "down", "carbon"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def slugify(c: Column | str) -> Column:
    bare = F.regexp_replace(F.lower(_c(c)), "['\"]", "")
    dashed = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("unknown"))


def normalized_name(c: Column | str) -> Column:
    """Lower case; apostrophes, acutes and backticks gone; dashes and underscores as spaces; single spaces."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), "['’´`]", ""), "[-_]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def name_tokens(c: Column | str) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def variant_of(c: Column | str) -> Column:
    """struct(base, variant, pattern) by the first pattern that matches the trimmed name."""
    name = F.trim(_c(c))
    made = lambda b, v, p: F.struct(b.alias("base"), v.alias("variant"), p.alias("pattern"))
    out = made(name, F.lit(""), F.lit("none"))
    for pattern, kind in reversed(VARIANT_PATTERNS):
        groups = [F.regexp_extract(name, pattern, i) for i in (2, 3)] if pattern.count("(") - pattern.count("(?") > 2 else [F.regexp_extract(name, pattern, 2)]
        variant = F.concat_ws(" ", *groups) if kind == "model_suffix" else F.concat(*groups)
        out = F.when(name.rlike(pattern), made(F.regexp_extract(name, pattern, 1), variant, F.lit(kind))).otherwise(out)
    return out


def brand_removal(name: Column | str, brand: Column | str) -> Column:
    """struct(rest, confidence): the name without its brand in front; null where it has none.

    The whole brand, else the longest run of its first words, else an equal first word of three
    letters or more.
    """
    n, b = _c(name), _c(brand)
    low, blow = F.lower(n), F.lower(b)
    words = F.split(blow, " ")
    made = lambda r, c: F.struct(F.trim(r).alias("rest"), c.cast("double").alias("confidence"))
    rest_after = lambda k: F.substr(n, k + F.lit(1))
    whole = F.startswith(low, F.concat(blow, F.lit(" ")))
    counts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    fits = F.filter(counts, lambda i: F.startswith(low, F.concat(F.array_join(F.slice(words, 1, i), " "), F.lit(" "))))
    longest = F.array_max(fits)
    prefix = F.length(F.array_join(F.slice(words, F.lit(1), longest), " "))
    first, bfirst = F.element_at(F.split(low, " "), 1), F.element_at(words, 1)
    by_word = F.when(F.length(bfirst) >= 6, 0.92).when(F.length(bfirst) >= 4, 0.88).otherwise(0.80)
    others = F.array_join(F.slice(F.split(n, r"\s+"), F.lit(2), F.size(F.split(n, r"\s+"))), " ")
    ok = n.isNotNull() & b.isNotNull() & (F.trim(b) != "")
    return (
        F.when(ok & whole, made(rest_after(F.length(b) + F.lit(1)), F.lit(0.98)))
        .when(ok & (F.size(words) > 1) & longest.isNotNull(), made(rest_after(prefix + F.lit(1)), F.lit(0.85) + F.lit(0.13) * longest / F.size(words)))
        .when(ok & (first == bfirst) & (F.length(bfirst) >= 3) & (others != ""), made(others, by_word))
    )


def category_of(c: Column | str) -> Column:
    """The first category one of whose keywords the text holds."""
    low = F.lower(_c(c))
    tests = [(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks]), cat) for cat, ks in CATEGORY_KEYWORDS.items()]
    return F.coalesce(*[F.when(t, cat) for t, cat in tests])


def prompt_tier(c: Column | str) -> Column:
    m, low = _c(c), F.lower(_c(c))
    return (
        F.when(low.rlike("|".join(f"(?:{p})" for p in HARD_PROMPTS)), "hard").when(low.rlike("|".join(f"(?:{p})" for p in EASY_PROMPTS)), "easy")
        .when((F.length(m) < 50) & F.contains(m, F.lit("?")), "easy").otherwise("standard")
    )


def materials_in(c: Column | str) -> Column:
    low = F.lower(_c(c))
    return F.filter(F.array(*[F.lit(m) for m in MATERIALS]), lambda m: F.contains(low, m))


def title_case(c: Column | str) -> Column:
    """A capital after every character that is no letter, unlike initcap."""
    parts = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.substr(p, F.lit(2)))), "")


def stutters(c: Column) -> Column:
    """Whether two to seven letters or digits stand twice in a row."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "").rlike(r"(.{2,7})\1")


def correction(value: Column) -> Column:
    """struct(corrected, confidence) of a text with a name that is known to be heard wrong.

    The first rule counts whose wrong form stands in the text as a word, or begins it, while the
    right form does not, and whose correction makes sense: it changes the text, holds the right
    form once, stutters nowhere and is not much longer.
    """
    low, tests = F.lower(value), []
    for wrong, right in rules.TRANSCRIPTION_ERRORS.items():
        w, r = wrong.lower(), right.lower()
        at = F.locate(w, low)
        fixed = F.concat(F.substr(value, F.lit(1), at - F.lit(1)), F.lit(right), F.substr(value, at + F.lit(len(w))))
        word = low.rlike(rf"\b{re.escape(w)}\b")
        rest = F.substr(value, F.lit(len(w) + 1))
        begins = F.startswith(low, F.lit(w)) & ~(rest.rlike(r"^\p{L}") & F.contains(F.lower(rest), F.lit(r)))
        flow = F.lower(fixed)
        sane = (fixed != value) & (F.length(flow) - F.length(F.replace(flow, F.lit(r), F.lit(""))) <= len(r)) & ~stutters(fixed) & (F.abs(F.length(fixed) - F.length(value)) <= len(right) + 5)
        confidence = F.when(low == w, 0.95).when(word, 0.90).otherwise(0.75)
        tests.append(F.when(~F.contains(low, F.lit(r)) & F.contains(low, F.lit(w)) & (word | begins) & sane, F.struct(fixed.alias("corrected"), confidence.alias("confidence"))))
    return F.coalesce(*tests)
