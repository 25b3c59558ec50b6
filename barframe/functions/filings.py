"""Classification of filing texts and corporate-action subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.functions.numbers import as_col

_START = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"

# Ordered text rules of announcement types.
EVENT_RULES = [
    (r"(emerges|declared).{0,25}(l-?1|lowest bidder)", "l1-bid"),
    (rf"letter of (intent|award)|{_START}loi{_END}|{_START}loa{_END}", "loi-loa"),
    (r"work order|purchase order|order (win|worth|received|bagg)|bags .{0,20}order"
     r"|secures .{0,20}(order|contract)|awarded .{0,20}(order|contract)|receipt of order", "firm-order"),
    (r"contract", "contract-other"),
]

# Categories that carry no news of their own.
NO_NEWS_CATEGORIES = ("Price movement", "Spurt in Volume", "News Verification")


def event_type(text: Column | str, rules=EVENT_RULES) -> Column:
    """First matching rule, case-insensitive, across line breaks; NULL when none matches."""
    c, out = as_col(text), None
    for pattern, label in rules:
        hit = c.rlike("(?is)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


# Wording of the two subjects that carry a ratio.
BONUS_RATIO = r"(?i)bonus\D{0,20}(\d+)\s*:\s*(\d+)"
FACE_VALUE = (
    r"(?i)from\s*(?:rs|re)?\.?\s*([\d.]+)\s*/?-?\s*(?:per share)?\s*to\s*(?:rs|re)?\.?\s*([\d.]+)"
)


def parse_action(subject: Column | str) -> tuple[Column, Column]:
    """(action_type, price factor) of a corporate-action subject line."""
    s = F.trim(F.regexp_replace(F.coalesce(as_col(subject), F.lit("")), r"\s+", " "))
    num = lambda pattern, i: F.regexp_extract(s, pattern, i).try_cast("double")
    is_bonus, a, b = s.rlike(BONUS_RATIO), num(BONUS_RATIO, 1), num(BONUS_RATIO, 2)
    old, new = num(FACE_VALUE, 1), num(FACE_VALUE, 2)
    has_face = s.rlike(FACE_VALUE) & (old > 0) & (new > 0)
    consolidates = s.rlike("(?i)consolidat")
    kind = (
        F.when(is_bonus, "bonus")
        .when(has_face & (consolidates | (new > old)), "consolidation")
        .when(has_face, "split")
        .when(s.rlike("(?i)split|sub-?division"), "split")
        .when(consolidates, "consolidation")
        .when(s.rlike("(?i)dividend"), "dividend")
        .otherwise("other")
    )
    factor = F.when(is_bonus, F.when((a > 0) & (b > 0), b / (a + b))).when(has_face, new / old)
    return kind, factor


def setup_base(name: Column | str) -> Column:
    """``dma-pullback-long@v1`` to ``dma-pullback``."""
    return F.regexp_replace(F.regexp_replace(as_col(name), "-long@.*", ""), "-short@.*", "")


def setup_direction(name: Column | str) -> Column:
    c = as_col(name)
    return F.when(c.like("%-long@%"), "long").when(c.like("%-short@%"), "short")


# Month codes of contract symbols.
MONTH_CODE = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6,
    "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
}
WEEKLY_MONTH_CODE = {
    "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6,
    "7": 7, "8": 8, "9": 9, "O": 10, "N": 11, "D": 12,
}
MONTHLY_SYMBOL = (
    r"^([A-Z&\-]+?)(\d{2})(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)(\d+(?:\.\d+)?)(CE|PE)$"
)
WEEKLY_SYMBOL = r"^([A-Z&\-]+?)(\d{2})([1-9OND])(\d{2})(\d+(?:\.\d+)?)(CE|PE)$"


def parse_contract_symbol(symbol: Column | str) -> Column:
    """Struct of contract terms; NULL for futures, equities, malformed text or impossible days.

    Monthly symbols carry no day, so their ``expiry`` stays NULL until it is looked up.
    """
    from barframe.functions.numbers import literal_lookup

    s = F.upper(F.trim(as_col(symbol)))
    m = lambda i: F.regexp_extract(s, MONTHLY_SYMBOL, i)
    w = lambda i: F.regexp_extract(s, WEEKLY_SYMBOL, i)
    year = lambda part: F.lit(2000) + part.try_cast("int")
    w_month = literal_lookup(w(3), WEEKLY_MONTH_CODE)
    w_text = F.concat_ws("-", year(w(2)).cast("string"), F.lpad(w_month.cast("string"), 2, "0"), w(4))
    w_expiry = F.to_date(F.try_to_timestamp(w_text, F.lit("yyyy-MM-dd")))

    def terms(under, yr, month, expiry, strike, opt, kind):
        return F.struct(
            under.alias("underlying"), yr.alias("expiry_year"), month.alias("expiry_month"),
            expiry.alias("expiry"), strike.cast("double").alias("strike"),
            opt.alias("option_type"), F.lit(kind).alias("expiry_kind"),
        )

    return F.when(
        s.rlike(MONTHLY_SYMBOL),
        terms(m(1), year(m(2)), literal_lookup(m(3), MONTH_CODE), F.lit(None).cast("date"), m(4), m(5), "monthly"),
    ).when(
        s.rlike(WEEKLY_SYMBOL) & w_expiry.isNotNull(),
        terms(w(1), year(w(2)), w_month, w_expiry, w(5), w(6), "weekly"),
    )
