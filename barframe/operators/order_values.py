"""The value of an order out of long filing texts.

Money mentions are found by two patterns whose matches and the text between them give each mention's
place and the words around it; which mentions count, how they score and which one wins are ordinary
columns, open to inspection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.numbers import literal_lookup
from barframe.operators.quantiles import exact_quantiles, with_quantiles
from barframe.operators.sessions import bind
from barframe.session import cut

c = F.col

# Units in crore, exchange rate, plausible range.
UNIT_CRORE = {
    "crore": 1.0, "crores": 1.0, "cr": 1.0, "crs": 1.0, "lakh": 0.01, "lakhs": 0.01, "lac": 0.01, "lacs": 0.01,
    "million": 0.1, "mn": 0.1, "millions": 0.1, "billion": 100.0, "bn": 100.0, "billions": 100.0,
}
USD_INR = 83.0
MIN_CRORE, MAX_CRORE = 0.05, 100_000.0

# Mention patterns, groups currency, number and unit; and unit, number where the unit comes first.
MONEY = (
    r"((?:US\s*\$|U\.?S\.?D|\$|Rs\.?|INR|₹)\s*)?(\d[\d,]*(?:\.\d+)?)\s*"
    r"(crores?|crs?\b|lakhs?|lacs?|millions?|mn\b|billions?|bn\b)")
UNIT_FIRST = (
    r"(?:in|value in|amount in)\s+(crores?|lakhs?|lacs?|millions?|billions?)"
    r"[^0-9%]{0,40}?(\d[\d,]*(?:\.\d+)?)")
#: Letters of either case; digits, spaces and word ends as Unicode has them.
FLAGS = "(?iU)"
DOLLAR = r"(?i)us\s*\$|u\.?s\.?d|\$"
CURRENCY = r"(?i)rs\.?|inr|₹|rupees|us\s*\$|u\.?s\.?d|\$"
QUANTITY = (
    r"(?i)^\s*(?:sq\.?\s*(?:ft|m|mtr|meter)|square|ft\b|sft|acres?|hectare|dwt|people|persons?|beneficiar|households?"
    r"|customers?|subscribers?|users?|mw\b|kw\b|gw\b|mwh|kwh|units?|nos\.?|numbers?|tonnes?|tons?|mt\b|km\b|kms|kilometer"
    r"|metres?|meters?|litres?|liters?|barrels?|shares?|equity|share)"
)

# Words that speak for or against a mention being the order's value.
STRONG = (
    "order value", "value of the order", "order worth", "contract value", "value of the contract", "aggregating to",
    "aggregate value", "amounting to", "total value", "valued at", "order of", "work order", "purchase order",
    "loa value", "letter of award", "contract price", "order amounting", "bagged an order", "received an order",
    "secured an order", "order for",
)
WEAK = ("order", "contract", "project", "award", "worth", "supply", "tender")
NEGATIVE = (
    "order book", "orderbook", "outstanding order", "unexecuted", "revenue", "turnover", "profit", "pat ", "ebitda",
    "net worth", "networth", "paid-up", "paid up", "share capital", "authorised capital", "authorized capital",
    "market cap", "face value", "dividend", "earnings per share", "eps ", "borrowing", "debt", "loan",
    "investment of", "capex", "capital expenditure", "total income", "gross", "net sales", "previous year",
    "corresponding quarter", "penalty", "penalties", "fine of", "liquidated damages", "earnest money",
    "bank guarantee", "security deposit", "emd", "performance guarantee", "stamp duty", "gst", "tax of", "fee of",
    "compensation of", "multinational", "conglomerate", "about the company", "about us", "is a usd", "is a us$",
    "is an usd", "group with", "company with", "annual revenue", "revenues of", "turnover of", "market leader",
    "employs", "founded in", "incorporated in", "operates in",
)

#: Characters that any rule looks back or ahead, and the shortest mention.
REACH, SHORTEST = 130, 3


def _found(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Columns ``<name>_found``, ``<name>_places`` and ``<name>_parts`` of every match of each pattern in ``_text``.

    Each is bound before it is used: a lambda over the matches would look for them again for each of them.
    """
    rest = [x for x in texts.columns if x != "_text"]
    looked = {}
    for name, pattern in patterns.items():
        looked[f"{name}_found"] = F.regexp_extract_all("_text", F.lit(FLAGS + pattern), F.lit(0))
        looked[f"{name}_gaps"] = F.split("_text", FLAGS + pattern, -1)
    put = {}
    for name in patterns:
        found, gaps = c(f"{name}_found"), c(f"{name}_gaps")
        # A running sum of lengths gives the places.
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
        put[f"{name}_places"] = F.aggregate(steps, start, lambda acc, x: F.struct((acc.at + x.g + x.m).alias("at"), F.array_append(acc.places, acc.at + x.g).alias("places"))).places
        # No rule looks across more than REACH characters, so only the ends of long gaps are carried along.
        short = F.transform(gaps, lambda g: F.when(F.length(g) > 2 * REACH, F.concat(F.left(g, F.lit(REACH)), F.right(g, F.lit(REACH)))).otherwise(g))
        put[f"{name}_parts"] = F.flatten(F.zip_with(short, found, lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
    out = bind(bind(texts, **looked), **put)
    return out.select(*rest, *[f"{n}_{x}" for n in patterns for x in ("found", "places", "parts")])


def _mentions(name: str, unit_first: bool) -> Column:
    """An array of (unit_first, pos, match, before, behind) of every match; contexts of ``REACH`` characters."""
    found, parts = c(f"{name}_found"), c(f"{name}_parts")
    reach = 2 * (REACH // SHORTEST + 2)

    def mention(place: Column, i: Column) -> Column:
        first = F.greatest(F.lit(1), 2 * i + 2 - reach)
        before = F.right(F.array_join(F.slice(parts, first, 2 * i + 2 - first), ""), F.lit(REACH))
        behind = F.left(F.array_join(F.slice(parts, 2 * i + 3, F.lit(reach)), ""), F.lit(REACH))
        return F.struct(F.lit(unit_first).alias("unit_first"), place.alias("pos"), F.element_at(found, i + 1).alias("match"), before.alias("before"), behind.alias("behind"))

    return F.transform(f"{name}_places", mention)


def money_mentions(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """Every money mention with position and context; a pure map, no shuffle.

    A mention needs a digit and a unit of money: texts without are left alone.
    """
    some = texts.select(key, c(text_col).alias("_text")).where(c("_text").rlike(r"\p{Nd}") & c("_text").rlike("(?i)(" + "|".join(sorted({u[:2] for u in UNIT_CRORE})) + ")"))
    looked = _found(some, {"_money": MONEY, "_units": UNIT_FIRST})
    rows = looked.select(key, F.inline(F.concat(_mentions("_money", False), _mentions("_units", True))))
    before, match, behind, first = c("before"), c("match"), c("behind"), c("unit_first")
    group = lambda pattern, i: F.regexp_extract(match, FLAGS + pattern, i)
    around = lambda n, m: F.concat(F.right(before, F.lit(n)), match, F.left(behind, F.lit(m)))
    return rows.select(
        key, "unit_first", "pos", F.when(~first, group(MONEY, 1)).alias("cur"),
        F.when(first, group(UNIT_FIRST, 2)).otherwise(group(MONEY, 2)).alias("num"), F.when(first, group(UNIT_FIRST, 1)).otherwise(group(MONEY, 3)).alias("unit"),
        F.left(behind, F.lit(22)).alias("after"), F.right(before, F.lit(28)).alias("lead"), around(30, 10).alias("around"), F.lower(around(70, 50)).alias("near"),
        F.lower(F.concat(before, F.lit(" "), F.left(behind, F.lit(90)))).alias("window"), around(70, 50).alias("evidence"))


def _has_any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def plausible(mentions: DataFrame) -> DataFrame:
    """Mentions that are money, in crore."""
    unit = F.rtrim(F.lower("unit"))
    mult = F.coalesce(literal_lookup(unit, UNIT_CRORE), literal_lookup(F.regexp_replace(unit, "s+$", ""), UNIT_CRORE))
    num = F.replace(c("num"), F.lit(","), F.lit("")).cast("double")
    dollars = ~c("unit_first") & (c("cur").rlike(DOLLAR) | c("around").rlike(DOLLAR))
    value = num * mult * F.when(dollars, F.lit(USD_INR)).otherwise(1.0)
    has_currency = c("unit_first") | (F.trim("cur") != "") | c("lead").rlike(CURRENCY)
    return mentions.withColumn("_raw", value).where(
        (num > 0) & ~c("after").rlike(QUANTITY) & has_currency & c("_raw").between(MIN_CRORE, MAX_CRORE)
    ).withColumn("value_cr", F.round("_raw", 2)).drop("_raw")


def scored(mentions: DataFrame) -> DataFrame:
    """Context score: +6/+3 strong words near/around, +1 weak words, -8/-4 negative words."""
    squeeze = lambda x: F.regexp_replace(c(x), r"[\s\-]+", " ")
    m = mentions.withColumns({"_near": squeeze("near"), "_win": squeeze("window")})
    near, win = c("_near"), c("_win")
    points = (
        F.when(_has_any(near, STRONG), 6).when(_has_any(win, STRONG), 3).otherwise(0)
        + F.when(_has_any(win, WEAK), 1).otherwise(0)
        - F.when(_has_any(near, NEGATIVE), 8).when(_has_any(win, NEGATIVE), 4).otherwise(0)
    )
    evidence = F.trim(F.regexp_replace("evidence", r"\s+", " "))
    return m.withColumn("score", points).withColumn("evidence", evidence).drop("_near", "_win")


def order_values_of_repeats(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """``order_values`` where many rows have the same text, as form letters have: equal texts are read once.

    The values of the different texts are written when the function is called, so the planner knows whether
    they are few enough to go to the rows.
    """
    marked = texts.withColumn("_same", F.sha2(c(text_col), 256))
    session = texts.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    different = marked.select("_same", text_col).where("_same is not null").distinct().repartition(tasks)
    each = cut(order_values(different, "_same", text_col), "values-of-texts")
    out = marked.drop(text_col).join(each, "_same", "left").drop("_same")
    return out.withColumns({"confidence": F.coalesce("confidence", F.lit("none")), "n_candidates": F.coalesce("n_candidates", F.lit(0).cast("long"))})


def order_values(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """Best value per text with confidence, evidence and number of distinct amounts."""
    rows = scored(plausible(money_mentions(texts, key, text_col)))
    seq = F.struct((-c("score")).alias("s"), "unit_first", "pos")
    per_value = rows.groupBy(key, "value_cr").agg(
        F.max("score").alias("score"), F.min_by("evidence", seq).alias("evidence"),
        F.min(F.struct("unit_first", "pos")).alias("first"),
    )
    w = Window.partitionBy(key).orderBy(c("score").desc(), "first")
    ranked = per_value.withColumns({
        "_r": F.row_number().over(w), "_second": F.lead("score").over(w),
        "n_candidates": F.count(F.lit(1)).over(Window.partitionBy(key)),
    })
    confidence = (
        F.when(c("score") <= 0, "low").when(c("n_candidates") == 1, "high")
        .when(c("score") >= c("_second") + 4, "high").when(c("score") >= c("_second") + 2, "medium").otherwise("low")
    )
    best = ranked.where(c("_r") == 1).select(key, "value_cr", confidence.alias("confidence"), "n_candidates", "evidence")
    return texts.drop(text_col).join(best, key, "left").withColumn(
        "confidence", F.coalesce("confidence", F.lit("none"))
    ).withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("long"))


def confidence_summary(values: DataFrame) -> DataFrame:
    values = cut(values.select("confidence", "value_cr"), "confidence-values")  # read for the counts and for the medians
    stats = values.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return with_quantiles(stats, exact_quantiles(values, ["confidence"], "value_cr", {"median_cr": 0.5}), ["confidence"])
