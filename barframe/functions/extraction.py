"""Structured facts from title + body text, one pass of built-in expressions per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.functions import keywords as K
from barframe.functions.numbers import round_half_up
from barframe.functions.text import SPACE

# Word edges on ASCII word characters, independent of the regex engine's Unicode mode.
_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
_WS = SPACE

# Patterns of tickers, companies, order values and contract kinds.
TICKER = rf"{_START}(?:NSE:{_WS}*)?([A-Z]{{2,20}}(?:EQ)?){_END}"
COMPANY = (
    rf"([A-Z][A-Za-z&{_WS[1:-1]}]+(?:Ltd\.?|Limited|Corporation|Corp\.?|Industries|Enterprises"
    r"|Technologies|Tech|Solutions|Infra|Infrastructure|Pharma|Chemicals))"
)
# What a text must hold for ``COMPANY`` to match.
COMPANY_WORDS = ("Ltd", "Limited", "Corp", "Industries", "Enterprises", "Tech", "Solutions", "Infra", "Pharma", "Chemicals")
_NUM = r"([\d,]+(?:\.\d+)?)"
_CUR = r"(?:₹|rs\.?|inr)"
_OF = rf"(?:order|contract|deal|project){_WS}+(?:worth|valued?{_WS}+at|of){_WS}+"
ORDER_VALUES = [
    rf"{_CUR}{_WS}*{_NUM}{_WS}*(?:crore|cr){_END}",
    rf"{_CUR}{_WS}*{_NUM}{_WS}*(?:lakh|lac){_END}",
    rf"{_CUR}{_WS}*{_NUM}{_WS}*(?:billion|bn){_END}",
    rf"{_CUR}{_WS}*{_NUM}{_WS}*(?:million|mn){_END}",
    rf"{_OF}{_CUR}?{_WS}*{_NUM}{_WS}*(?:crore|cr){_END}",
    rf"{_OF}{_CUR}?{_WS}*{_NUM}{_WS}*(?:lakh|lac){_END}",
    # A word edge before "[\d,]": the neighbour must differ in kind from the first character.
    rf"(?:{_START}(?=\d)|(?<=[A-Za-z0-9_])(?=,)){_NUM}{_WS}*(?:crore|cr){_END}",
]
# What a text must hold for the pattern of the same place to match.
VALUE_WORDS = [("cr",), ("lakh", "lac"), ("billion", "bn"), ("million", "mn"), ("cr",), ("lakh", "lac"), ("cr",)]
ORDER_UNITS = [
    (rf"crore|cr{_END}", "Cr"), (rf"lakh|lac{_END}", "Lakh"),
    (rf"billion|bn{_END}", "Bn"), (rf"million|mn{_END}", "Mn"),
]
CONTRACT_KINDS = [
    (rf"order{_WS}+win", "Order Win"),
    (rf"work{_WS}+order", "Work Order"),
    (rf"purchase{_WS}+order", "Purchase Order"),
    (r"epc", "EPC Contract"),
    (r"turnkey", "Turnkey Project"),
    (r"amc", "AMC Contract"),
    (rf"letter{_WS}+of{_WS}+intent|loi", "LoI"),
    (rf"pal|product{_WS}+approval", "Product Approval"),
    (r"acquisition", "Acquisition"),
    (r"merger", "Merger"),
    (rf"joint{_WS}+venture|jv", "Joint Venture"),
    (r"buyback", "Buyback"),
    (r"dividend", "Dividend"),
    (r"bonus", "Bonus Issue"),
    (rf"stock{_WS}+split", "Stock Split"),
    (rf"quarterly{_WS}+results?", "Quarterly Results"),
    (rf"block{_WS}+deal", "Block Deal"),
    (rf"bulk{_WS}+deal", "Bulk Deal"),
]


KIND_WORDS = [
    ("win",), ("order",), ("purchase",), ("epc",), ("turnkey",), ("amc",), ("intent", "loi"), ("pal", "approval"), ("acquisition",),
    ("merger",), ("venture", "jv"), ("buyback",), ("dividend",), ("bonus",), ("split",), ("quarterly",), ("block",), ("bulk",),
]


def ticker(text: Column) -> Column:
    """First upper-case word, when it is not on the stop list and has three letters."""
    candidate = F.regexp_replace(F.regexp_extract(text, TICKER, 1), "EQ$", "")
    return F.when((F.length(candidate) >= 3) & ~candidate.isin(*K.NOT_TICKERS), candidate)


def company_name(text: Column) -> Column:
    found = F.when(_holds(text, *COMPANY_WORDS), F.regexp_extract(text, COMPANY, 1))
    return F.nullif(F.regexp_replace(found, f"^{_WS}+|{_WS}+$", ""), F.lit(""))


def keyword_hits(lower_text: Column) -> Column:
    """All dictionary entries found, as (keyword, category), in dictionary order.

    The text is searched once per entry; tags, sector and keyword list all derive from this.
    """
    entries = F.array(*[
        F.struct(F.lit(w).alias("keyword"), F.lit(w.lower()).alias("needle"), F.lit(c).alias("category"))
        for c, words in K.CATEGORIES.items() for w in words
    ])
    return F.filter(entries, lambda e: F.contains(lower_text, e["needle"]))


def matched_keywords(hits: Column) -> Column:
    return F.transform(hits, lambda e: e["keyword"])


def category_tags(hits: Column) -> Column:
    return F.array_distinct(F.transform(hits, lambda e: e["category"]))


def primary_sector(hits: Column) -> Column:
    """Sector with most hits; the first in the fixed order wins ties, none is NULL."""
    names = F.array(*[F.lit(s) for s in K.SECTORS])
    counts = F.transform(names, lambda s: F.size(F.filter(hits, lambda e: e["category"] == s)))

    def first_best(n: Column) -> Column:
        best = F.array_max(n)
        return F.when(best > 0, F.element_at(names, F.array_position(n, best).cast("int")))

    # Counted once: compared sector by sector, the optimiser would count all of them again for each.
    return F.element_at(F.transform(F.array(counts), first_best), 1)


def _holds(text: Column, *words: str) -> Column:
    """A quick look for any of ``words``, before an expression that cannot match without one of them."""
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def order_value(lower_text: Column) -> Column:
    """First positive amount by the ordered patterns (first match of each)."""
    values = []
    for pattern, words in zip(ORDER_VALUES, VALUE_WORDS, strict=True):
        found = F.when(_holds(lower_text, *words), F.regexp_extract(lower_text, "(?i)" + pattern, 1))
        digits = F.replace(found, F.lit(","), F.lit(""))
        values.append(F.get(F.filter(F.array(digits.try_cast("double")), lambda v: v > 0), 0))
    return F.coalesce(*values)


def order_unit(lower_text: Column) -> Column:
    out = None
    for pattern, unit in ORDER_UNITS:
        hit = lower_text.rlike("(?i)" + pattern)
        out = F.when(hit, unit) if out is None else out.when(hit, unit)
    return out


def contract_kind(lower_text: Column) -> Column:
    out = None
    for (pattern, kind), words in zip(CONTRACT_KINDS, KIND_WORDS, strict=True):
        hit = _holds(lower_text, *words) & lower_text.rlike(rf"(?i){_START}(?:{pattern}){_END}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def _order_points(value: Column, unit: Column) -> Column:
    crores = (
        F.when(unit == "Lakh", value / 100.0).when(unit == "Bn", value * 100.0)
        .when(unit == "Mn", value / 10.0).otherwise(value)
    )
    out = F.when(value.isNull() | (value == 0), F.lit(0.3))
    # Crore steps of the order-value component.
    for edge, points in ((10000, 1.0), (5000, 0.9), (1000, 0.8), (500, 0.7), (100, 0.6), (50, 0.5), (10, 0.4)):
        out = out.when(crores >= edge, F.lit(points))
    return out.otherwise(F.lit(0.3))


def _recency_points(published: Column, as_of: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(published)) / F.lit(3600e6)
    out = None
    # Age steps in hours.
    for edge, points in ((1, 1.0), (4, 0.9), (12, 0.7), (24, 0.5), (48, 0.3)):
        out = F.when(hours < edge, F.lit(points)) if out is None else out.when(hours < edge, F.lit(points))
    return out.otherwise(F.lit(0.2))


def _present(needles: tuple, lower_keywords: Column) -> Column:
    """How many needles occur inside at least one matched keyword; the keywords stand in one text, a mark between them."""
    return sum((F.contains(lower_keywords, F.lit(n)).cast("int") for n in needles), F.lit(0))


def impact_score(
    keywords: Column, tags: Column, value: Column, unit: Column, published: Column, as_of: Column
) -> Column:
    """Rule score 1..10 with its four components, as a struct."""
    lowered = F.lower(F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), "\0"))
    tag_count = F.size(F.coalesce(tags, F.array().cast("array<string>")))
    order, recency = _order_points(value, unit), _recency_points(published, as_of)

    def scores(n_boost: Column, n_high: Column) -> Column:
        sector = F.least(
            F.lit(0.3) + F.least(n_boost * F.lit(0.15), F.lit(0.5)) + F.least(tag_count * F.lit(0.1), F.lit(0.2)), F.lit(1.0))
        density = F.when(n_high >= 3, 0.9).when(n_high >= 2, 0.7).when(n_high >= 1, 0.5).otherwise(0.3)
        total = order * 3.0 + sector * 1.5 + recency * 2.0 + density * 3.5
        return F.struct(
            F.greatest(F.lit(1.0), F.least(F.lit(10.0), round_half_up(total, 1))).alias("total_score"),
            round_half_up(density, 2).alias("keyword_score"),
            round_half_up(sector, 2).alias("sector_score"),
            round_half_up(recency, 2).alias("recency_score"),
            round_half_up(order, 2).alias("order_value_score"),
        )

    # Needles are counted once, and not again for each component and step that asks for them.
    once = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)
    present = once(lowered, lambda x: F.struct(_present(K.SECTOR_BOOST, x).alias("boost"), _present(K.HIGH_IMPACT, x).alias("high")))
    return once(present, lambda n: scores(n["boost"], n["high"]))
