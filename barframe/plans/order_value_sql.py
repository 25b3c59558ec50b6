"""The SQL twin of the order-value operator: the same rules by absolute places in the text."""

from __future__ import annotations

from barframe.operators import order_values as o


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(text: str, words) -> str:
    return f"len([x FOR x IN [{', '.join(_quoted(w) for w in words)}] IF contains({text}, x)]) > 0"


def _unit(name: str) -> str:
    return f"CASE {name} {' '.join(f'WHEN {_quoted(u)} THEN {v:e}' for u, v in o.UNIT_CRORE.items())} END"


def order_values(relation: str, key: str, text: str) -> str:
    """(key, value_cr, confidence, n_candidates, evidence) of every row of ``relation``."""
    money, unit_first = (_quoted("(?i)" + p) for p in (o.MONEY, o.UNIT_FIRST))
    found = lambda pattern, first: (
        f"SELECT {key}, {text} AS t, lower({text}) AS low, {first} AS unit_first, regexp_extract_all({text}, {pattern}) AS f, string_split_regex({text}, {pattern}) AS g FROM {relation}")
    before = lambda s, n: f"substr({s}, greatest(a - {n}, 0) + 1, least({n}, a))"
    around = lambda s, n, m: f"substr({s}, greatest(a - {n}, 0) + 1, b + {m} - greatest(a - {n}, 0))"
    squeezed = lambda s: f"regexp_replace({s}, '[\\s\\-]+', ' ', 'g')"
    return f"""
    WITH found AS ({found(money, 'false')} UNION ALL {found(unit_first, 'true')}),
    each_ AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM found WHERE len(f) > 0),
    placed AS (SELECT *, f[i] AS m, (list_sum([length(v) FOR v IN g[:i]]) + coalesce(list_sum([length(v) FOR v IN f[:i - 1]]), 0))::BIGINT AS a FROM each_),
    spans AS (SELECT *, a + length(m) AS b FROM placed),
    mention AS (SELECT {key}, unit_first, a, CASE WHEN NOT unit_first THEN regexp_extract(m, {money}, 1) END AS cur,
      CAST(replace(CASE WHEN unit_first THEN regexp_extract(m, {unit_first}, 2) ELSE regexp_extract(m, {money}, 2) END, ',', '') AS DOUBLE) AS num,
      rtrim(lower(CASE WHEN unit_first THEN regexp_extract(m, {unit_first}, 1) ELSE regexp_extract(m, {money}, 3) END)) AS unit,
      substr(t, b + 1, 22) AS behind, {before('t', 28)} AS ahead, {around('t', 30, 10)} AS around, {squeezed(around('low', 70, 50))} AS near,
      {squeezed(before('low', 130) + " || ' ' || substr(low, b + 1, 90)")} AS win, trim(regexp_replace({around('t', 70, 50)}, '\\s+', ' ', 'g')) AS evidence FROM spans),
    raw AS (SELECT *, num * coalesce({_unit('unit')}, {_unit("regexp_replace(unit, 's+$', '')")})
        * CASE WHEN NOT unit_first AND (regexp_matches(cur, {_quoted(o.DOLLAR)}) OR regexp_matches(around, {_quoted(o.DOLLAR)})) THEN {o.USD_INR:e} ELSE 1e0 END AS raw FROM mention),
    fit AS (SELECT *, floor(raw * 1e2 + 5e-1) / 1e2 AS value_cr,
      CASE WHEN {_any('near', o.STRONG)} THEN 6 WHEN {_any('win', o.STRONG)} THEN 3 ELSE 0 END + CASE WHEN {_any('win', o.WEAK)} THEN 1 ELSE 0 END
        - CASE WHEN {_any('near', o.NEGATIVE)} THEN 8 WHEN {_any('win', o.NEGATIVE)} THEN 4 ELSE 0 END AS score
      FROM raw WHERE num > 0 AND NOT regexp_matches(behind, {_quoted(o.QUANTITY)}) AND (unit_first OR trim(cur) <> '' OR regexp_matches(ahead, {_quoted(o.CURRENCY)}))
        AND raw BETWEEN {o.MIN_CRORE:e} AND {o.MAX_CRORE:e}),
    per_value AS (SELECT {key}, value_cr, max(score) AS score, arg_min(evidence, (-score, unit_first, a)) AS evidence, min((unit_first, a)) AS first_ FROM fit GROUP BY {key}, value_cr),
    ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second_, count(*) OVER (PARTITION BY {key}) AS n FROM per_value WINDOW w AS (PARTITION BY {key} ORDER BY score DESC, first_)),
    best AS (SELECT {key}, value_cr, n, evidence, CASE WHEN score <= 0 THEN 'low' WHEN n = 1 THEN 'high' WHEN score >= second_ + 4 THEN 'high' WHEN score >= second_ + 2 THEN 'medium' ELSE 'low' END AS confidence
      FROM ranked WHERE r = 1)
    SELECT s.{key}, value_cr, coalesce(confidence, 'none') AS confidence, coalesce(n, 0)::BIGINT AS n_candidates, evidence FROM {relation} s LEFT JOIN best USING ({key})"""
