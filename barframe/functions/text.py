"""Normalisation, hashing and similarity of titles and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.functions.numbers import as_col

# White space as a browser engine sees it, not only the ASCII part.
SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Hosts whose "/url" page is a redirect to the real article.
REDIRECT_HOSTS = ("google.com", "google.co.in", "google.co.uk")

FUZZY_MIN_LENGTH = 20
FUZZY_THRESHOLD = 0.30


def normalize_text(c: Column | str) -> Column:
    """Lower case, everything but ASCII word characters to single spaces, trimmed.

    Dropping punctuation and then collapsing white space is one replacement, since every
    dropped character becomes a space first.
    """
    return F.trim(F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9_]+", " "))


def _bare_url(url: Column) -> Column:
    """host + path, no trailing slash, lower case; NULL when the text is not a URL."""
    scheme = r"(?i)^\s*[a-z][a-z0-9+.\-]*:"
    host = F.regexp_extract(url, scheme + r"//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    path = F.regexp_extract(url, scheme + r"(?://[^/?#]*)?([^?#]*)", 1)
    bare = F.lower(F.regexp_replace(F.concat(host, path), "/+$", ""))
    web_without_host = url.rlike(r"(?i)^\s*(https?|ftp|wss?):") & (host == "")
    return F.when(url.rlike(scheme) & ~web_without_host, bare)


def normalize_url(c: Column | str) -> Column:
    """Comparable form of a link; search-engine redirects are unwrapped to their target."""
    url = as_col(c)
    host = F.lower(F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    known = F.lit(False)
    for name in REDIRECT_HOSTS:
        known = known | F.contains(host, F.lit(name))
    # Most links are no redirects: a look for the path comes before the expressions.
    is_redirect = F.contains(url, F.lit("/url")) & (path == "/url") & known
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    param = lambda name: F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1), F.lit(""))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    target = once(F.coalesce(param("url"), param("q")), lambda raw: F.coalesce(F.try_url_decode(raw), raw))
    unwrapped = F.when(is_redirect, once(target, lambda t: F.coalesce(_bare_url(t), F.lower(F.trim(t)))))
    return F.coalesce(unwrapped, _bare_url(url), F.lower(F.trim(url)))


def content_key(title: Column | str, link: Column | str) -> Column:
    return F.concat(normalize_text(title), F.lit("|"), normalize_url(link))


def content_id(title: Column | str, link: Column | str) -> Column:
    """64-hex identity of an item: same normalised title and link, same id."""
    return F.sha2(content_key(title, link), 256)


def djb2_hex(c: Column | str) -> Column:
    """32-bit xor-multiply hash as lower-case hex."""
    text = as_col(c)
    # Split once: the text, however it is made, is not made again for each of its characters.
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    codes = F.transform(letters, lambda x: F.ascii(x).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    folded = F.aggregate(
        codes,
        F.lit(5381).cast("long"),
        lambda h, x: (h * F.lit(33)).bitwiseXOR(x).bitwiseAND(mask),
    )
    return F.lower(F.hex(folded))


def content_hash(title: Column | str, link: Column | str) -> Column:
    return djb2_hex(content_key(title, link))


def titles_similar(norm_a: Column, norm_b: Column, threshold: float = FUZZY_THRESHOLD) -> Column:
    """Near-duplicate test on two *normalised* titles.

    Short titles must be equal. Longer ones may differ by ``threshold`` of the longer length;
    a difference of lengths above that settles it without a distance.
    """
    longest = F.greatest(F.length(norm_a), F.length(norm_b))
    distance = F.levenshtein(norm_a, norm_b)
    return (
        F.when(longest == 0, F.lit(True))
        .when(longest < FUZZY_MIN_LENGTH, norm_a == norm_b)
        .when(F.abs(F.length(norm_a) - F.length(norm_b)) > longest * threshold, F.lit(False))
        .otherwise(distance / longest <= threshold)
    )


def strip_html(c: Column | str) -> Column:
    """Tags to spaces, then the six common entities in order, then white space collapsed."""
    out = F.regexp_replace(as_col(c), "<[^>]*>", " ")
    # Entities and their order.
    for entity, char in (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"),
        ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def contains_ignore_case(fields: list[Column], arrays: list[Column], query: str) -> Column:
    """Free-text search over scalar and array fields joined by spaces."""
    joined = [F.nullif(f, F.lit("")) for f in fields] + [
        F.nullif(F.array_join(a, " "), F.lit("")) for a in arrays
    ]
    needle = query.strip().lower()
    return F.contains(F.lower(F.concat_ws(" ", *joined)), F.lit(needle)) if needle else F.lit(True)
