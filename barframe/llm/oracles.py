"""SQL twins (DuckDB) of the numbered queries that SQL can express."""

from __future__ import annotations

from barframe.llm import collocations, leaks, mixing, neardup, substrings

_TEXT = "coalesce(text, '')"
_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+')"
_FOLDED = rf"regexp_extract_all(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _runs(width: int, words: str = "w") -> str:
    """All runs of ``width`` words of a list of words, as strings."""
    return f"[array_to_string({words}[i:i + {width - 1}], ' ') FOR i IN range(1, len({words}) - {width - 2})]"


def _shingles(width: int) -> str:
    return f"CASE WHEN len(w) >= {width} THEN list_distinct({_runs(width)}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"


SQL_OP5 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, {mixing.EPOCHS} * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0) AS spare, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS open
      FROM w WINDOW earlier AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT spare, open FROM o WHERE spare * weight < cap * open ORDER BY cap / weight, source NULLS FIRST LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.spare * weight >= cap * o.open THEN cap::DOUBLE ELSE (l.spare * weight)::DOUBLE / l.open END AS target FROM o LEFT JOIN l ON true),
g AS (SELECT *, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.rounds, g.goal - g.rounds * g.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, rest - earlier)) AS BIGINT) AS taken FROM r
"""

SQL_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
h AS (SELECT rid, doc_id, {_runs(substrings.WINDOW)} AS runs FROM d),
g AS (SELECT rid, doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS p FROM h),
f AS (SELECT run, min(doc_id) AS first_id FROM g GROUP BY run),
x AS (SELECT DISTINCT rid, unnest(range(p, p + {substrings.WINDOW})) AS p FROM g JOIN f USING (run) WHERE g.doc_id > f.first_id),
k AS (SELECT d.rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT k.rid, array_to_string(list(word ORDER BY k.p), ' ') AS text, count(*) AS n FROM k LEFT JOIN x ON k.rid = x.rid AND k.p = x.p WHERE x.rid IS NULL GROUP BY k.rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

SQL_OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS (SELECT doc_id, {_shingles(neardup.SHINGLE)} AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS either
      FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * common >= {neardup.PERCENT} * either UNION ALL SELECT b, a FROM c WHERE 100 * common >= {neardup.PERCENT} * either),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

SQL_OP8 = rf"""
WITH q AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), {leaks.SHINGLE}) AS width, {_shingles(leaks.SHINGLE)} AS s FROM q),
ie AS (SELECT item_id, width, len(s) AS n, unnest(s) AS shingle FROM i),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
de AS (SELECT doc_id, k AS width, unnest(list_distinct([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)])) AS shingle
       FROM d, (SELECT DISTINCT width AS k FROM i WHERE width > 0) WHERE len(w) >= k)
SELECT doc_id, item_id, any_value(n)::BIGINT AS item_shingles, count(*)::BIGINT AS shared_shingles FROM de JOIN ie USING (width, shingle)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= {leaks.PERCENT} * any_value(n)
"""

SQL_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TEXT} AS t, {_WORDS} AS w FROM documents),
h AS (SELECT rid, {_runs(3)} AS runs FROM d),
g AS (SELECT rid, unnest(runs) AS run, generate_subscripts(runs, 1) AS p FROM h),
twice AS (SELECT rid, run FROM g GROUP BY rid, run HAVING count(*) >= 2),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM g JOIN twice USING (rid, run)) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(t, '[A-Z]')) AS upper_, len(regexp_extract_all(t, '[a-z]')) AS lower_, len(regexp_extract_all(t, '!')) AS shouts
      FROM d LEFT JOIN rep USING (rid)),
v AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 8 * word_chars OR 100 * upper_ > 60 * (upper_ + lower_) OR 100 * shouts > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 60 * len(lines)) AS kept
FROM v
"""

SQL_OP12 = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(flatten([[w[i:i + k] FOR i IN range(1, len(w) - k + 1)] FOR k IN range(0, {collocations.ORDER})])) AS w FROM p),
f AS (SELECT lang, w, array_to_string(w, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, w HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT lang, w, phrase, f AS a FROM f WHERE len(w) > 1),
k AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, ({collocations.SCALE}::HUGEINT * k.a) // (l.f + r.f) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.w = k.w[1:k.k] JOIN f r ON r.lang = k.lang AND r.w = k.w[k.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, array_to_string(unnest(flatten([[w[i:i + m] FOR i IN range(1, len(w) - m + 1)] FOR m IN range(1, len(w) - 1)])), ' ') AS phrase FROM c WHERE len(w) > 2),
o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY lang, phrase),
v AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase)
      WHERE around IS NULL OR 100::HUGEINT * around < {collocations.COVERED}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM v JOIN t USING (lang) WHERE rank <= {collocations.TOP}
"""

ORACLES = {
    "op5_mixing": SQL_OP5, "op6_substring_dedup": SQL_OP6, "op7_near_duplicates": SQL_OP7, "op8_benchmark_leaks": SQL_OP8, "op9_quality_rules": SQL_OP9,
    "op12_collocations": SQL_OP12,
}
