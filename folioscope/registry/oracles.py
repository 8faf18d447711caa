"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..operators import banks, design, page, prose
from . import samples as S

AS_OF = "DATE '2024-06-01'"
_Q = S.quoted


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _n(x: str) -> str:
    return f"len({_tokens(x)})"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_Q(pattern)}))"


def _sentences(x: str) -> str:
    return rf"string_split_regex({x}, '[.!?]+\s+')"


def _half(x: str, digits: int) -> str:
    return f"round(({x}) * {10**digits}.0) / {10**digits}"


def _pct(offset: str, total: str) -> str:
    return f"round(CAST({offset} AS DOUBLE) / {total} * 1000) / 10"


def _first_pct(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(u, {_Q(pattern)}) THEN {_pct(_n(f'string_split_regex(u, {_Q(pattern)})[1]'), 'n')} END"


_KEYWORDS = f"list_filter(list_transform(regexp_extract_all(u, {_Q(prose.KEYWORD)}), lambda w: lower(w)), lambda w: NOT list_contains([{', '.join(map(_Q, prose.STOP_WORDS))}], w))"

_KEYWORD_COUNTS = f"""
SELECT doc_id, term, count, round(CAST(count AS DOUBLE) / total * 1000) / 10 AS density, rank FROM (
  SELECT *, sum(count) OVER (PARTITION BY doc_id) AS total, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) AS INTEGER) AS rank
  FROM (SELECT doc_id, term, count(*) AS count FROM (SELECT doc_id, unnest({_KEYWORDS}) AS term FROM {S.ASCII_SQL}) GROUP BY 1, 2))
WHERE rank <= 5
"""

_QUESTIONS = f"""
SELECT doc_id, string_agg(q, '|' ORDER BY i) AS questions FROM (
  SELECT doc_id, i, q, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, q, i, row_number() OVER (PARTITION BY doc_id, lower(q) ORDER BY i) AS same FROM (
      SELECT doc_id, unnest(qs) AS q, unnest(range(0, len(qs))) AS i FROM (SELECT doc_id, regexp_extract_all(b, {_Q(prose.QUESTION)}, 1) AS qs FROM {S.PROSE_SQL})))
  WHERE same = 1) WHERE k <= 10 GROUP BY doc_id
"""

_KEYWORDS_SQL = f"""
WITH t AS ({_KEYWORD_COUNTS}), q AS ({_QUESTIONS})
SELECT d.doc_id, coalesce(terms, '') AS terms, coalesce(questions, '') AS questions FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(term || ':' || count, '|' ORDER BY rank) AS terms FROM t GROUP BY 1) USING (doc_id) LEFT JOIN q USING (doc_id)
"""

_STRIP = rf"regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^(?i:(?:{'|'.join(prose.HONORIFICS)}) )*', '')"
_PEOPLE = f"""
WITH m AS (
  SELECT doc_id, 0 AS pass, unnest(range(0, len(xs))) AS i, unnest(xs) AS x, unnest(cs) AS c FROM (SELECT doc_id, regexp_extract_all(u, {_Q(prose.NAME_WITH_CREDENTIAL)}, 1) AS xs, regexp_extract_all(u, {_Q(prose.NAME_WITH_CREDENTIAL)}, 2) AS cs FROM {S.ASCII_SQL})
  UNION ALL SELECT doc_id, 1, unnest(range(0, len(xs))), unnest(xs), NULL FROM (SELECT doc_id, regexp_extract_all(u, {_Q(prose.TITLED_NAME)}, 1) AS xs FROM {S.ASCII_SQL})
), n AS (SELECT doc_id, pass, i, {_STRIP} AS name, upper(replace(c, '.', '')) AS credentials FROM m
), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pass, i) AS k FROM n WHERE len(string_split(name, ' ')) >= 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pass, i) - 1 AS INTEGER) AS pos, name, credentials FROM f WHERE k = 1
"""

_ORG_ROWS = f"SELECT doc_id, unnest(list_transform(range(1, len(a) + 1), lambda i: a[i] || ' ' || z[i])) AS name FROM (SELECT doc_id, regexp_extract_all(u, {_Q(prose.ORGANIZATION)}, 1) AS a, regexp_extract_all(u, {_Q(prose.ORGANIZATION)}, 2) AS z FROM {S.ASCII_SQL})"
_ORGANIZATIONS = f"""
WITH h AS (SELECT doc_id, lower(trim(unnest(hs))) AS title FROM {S.TITLES_SQL} UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'the smith foundation' ELSE 'none' END FROM documents)
SELECT doc_id, name, count(*) AS mentions FROM ({_ORG_ROWS}) r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = r.doc_id AND h.title = lower(r.name)) GROUP BY 1, 2 HAVING count(*) >= 2
"""
_ORGS_BY_ROW = f"""
WITH o AS (SELECT doc_id, name FROM ({_ORG_ROWS}) WHERE NOT (doc_id % 2 = 0 AND lower(name) = 'acme research institute') GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS i FROM o)
SELECT d.doc_id, coalesce(s, '') AS organizations FROM documents d LEFT JOIN (SELECT doc_id, string_agg(name, '|' ORDER BY name) AS s FROM k WHERE i <= 20 GROUP BY 1) USING (doc_id)
"""

_EVIDENCE = rf"""
WITH t AS (SELECT *, {_n('b')} AS n FROM {S.ASCII_SQL}), p AS (
  SELECT doc_id, b, u, n, string_split_regex(u, {_Q(prose.CLAIM)}) AS ps, regexp_extract_all(u, {_Q(prose.CLAIM)}) AS cs FROM t
), c AS (
  SELECT doc_id, b, n, unnest(range(1, len(cs) + 1)) AS i, ps, cs FROM p
), o AS (
  SELECT doc_id, b, n, i, CAST(list_sum(list_transform(range(1, i + 1), lambda k: length(ps[k]))) + coalesce(list_sum(list_transform(range(1, i), lambda k: length(cs[k]))), 0) AS BIGINT) AS o FROM c
), w AS (
  SELECT doc_id, i, substr(b, o + 1, 400) AS w, round(CAST({_n('substr(b, 1, o)')} AS DOUBLE) / n * 1000) / 10 AS pct FROM o
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM w WHERE NOT regexp_matches(w, {_Q(prose.CITATION)}))
SELECT t.doc_id, {_count('u', prose.STATISTIC)} AS stat_count, {_count('b', prose.QUOTE)} AS quote_count, coalesce(s, '') AS claims FROM t
LEFT JOIN (SELECT doc_id, string_agg(trim(substr(w, 1, 120)) || ':' || CAST(pct AS VARCHAR), '|' ORDER BY i) AS s FROM k WHERE r <= 10 GROUP BY 1) USING (doc_id)
"""

_SNIPPET = rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform({_sentences('b')}, lambda x: trim(x)), lambda x: x <> '') AS ss FROM {S.PROSE_SQL}
), e AS (SELECT doc_id, unnest(ss) AS x, unnest(range(0, len(ss))) AS i FROM s
), c AS (SELECT doc_id, i, sum({_n('x')}) OVER (PARTITION BY doc_id ORDER BY i) AS c, {_n('x')} AS w FROM e
), p AS (SELECT a.doc_id, a.i, min(z.i) AS j FROM c a JOIN c z ON a.doc_id = z.doc_id AND z.i >= a.i AND z.c - (a.c - a.w) BETWEEN 30 AND 50 GROUP BY 1, 2
), f AS (SELECT doc_id, min(i) AS i, min_by(j, i) AS j FROM p GROUP BY 1)
SELECT s.doc_id, CASE WHEN f.i IS NOT NULL THEN array_to_string(ss[f.i + 1 : f.j + 1], ' ') END AS snippet FROM s LEFT JOIN f USING (doc_id)
"""

_POSITION = f"""
SELECT doc_id, n AS total_words, t AS tldr_position_pct, s AS first_stat_position_pct, c AS first_credential_position_pct,
  CASE WHEN t > 10 THEN 1 ELSE 0 END + CASE WHEN s > 30 THEN 1 WHEN s IS NULL AND n >= 200 THEN 1 ELSE 0 END AS warnings
FROM (SELECT doc_id, n, {_first_pct(prose.ANSWER_BLOCK)} AS t, {_first_pct(prose.POSITION_STATISTIC)} AS s, {_first_pct(prose.POSITION_CREDENTIAL)} AS c FROM (SELECT *, {_n('b')} AS n FROM {S.ASCII_SQL}))
"""

_GAIN = f"""
SELECT doc_id, least(10, named_quotes + sample_sizes + yoy_deltas + first_person_evidence + method_disclosure + least(5, numbered_citations)) AS score, {', '.join(prose.ORIGINALITY)},
  {' + '.join(f'least(3, {k})' for k in prose.SAMPLE_KINDS)} AS samples
FROM (SELECT doc_id, {', '.join(f'{_count("u", p)} AS {k}' for k, p in prose.ORIGINALITY.items())} FROM {S.ASCII_SQL})
"""


def _ladder(x: str, levels: list) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {over} THEN {points}" for over, points in levels) + " ELSE 0 END"


def _copy() -> str:
    counts = {k: _count("u", p) for k, p in prose.PRECISION.items()}
    counts["ly_adverbs"] = f"len(list_filter(regexp_extract_all(u, {_Q(prose.PRECISION['ly_adverbs'])}), lambda w: lower(w) NOT IN ({', '.join(map(_Q, prose.NOT_ADVERBS))})))"
    per = {k: f"(round({k} * 1000.0 / n * 10) / 10)" for k in prose.PENALTIES}
    before = " + ".join(_ladder(per[k], prose.PENALTIES[k]) for k in ("filler_words", "ly_adverbs", "hedged_modals", "empty_emphasis_adjectives"))
    columns = ", ".join(prose.PRECISION)
    return f"""
WITH t AS (SELECT doc_id, {_n('b')} AS n, list_filter(list_transform({_sentences('b')}, lambda s: {_n('s')}), lambda k: k > 0) AS ls, list_sum(list_transform({_tokens('b')}, lambda w: length(w))) AS chars, {', '.join(f'{v} AS {k}' for k, v in counts.items())} FROM {S.ASCII_SQL}
), a AS (SELECT *, CASE WHEN len(ls) >= 4 THEN sqrt(list_sum(list_transform(ls, lambda k: (k - list_avg(ls)) * (k - list_avg(ls)))) / len(ls)) / list_avg(ls) ELSE 0.45 END AS ratio, chars / n AS word, (proper_nouns + numerics) * 100.0 / n AS concrete FROM t WHERE n > 0
), p AS (SELECT *, {before} + least(3, throat_clearing_openers) + least(3, filler_phrases) + CASE WHEN ratio < 0.30 AND len(ls) >= 6 THEN 2 ELSE 0 END + {_ladder('word', [(5.8, 2), (5.4, 1)])} AS pen FROM a
), q AS (SELECT *, CASE WHEN concrete < 2 AND n >= 200 THEN pen + 2.0 WHEN concrete > 5 THEN greatest(pen - 0.5, 0.0) ELSE pen END + {_ladder(per['passive_voice'], prose.PENALTIES['passive_voice'])} AS pen2 FROM p
), s AS (SELECT *, 10 - least(pen2, 10) AS raw, n >= {prose.LEAST_TOKENS} AS enough FROM q)
SELECT doc_id, CASE WHEN enough THEN CAST(round(raw * 10) / 10 AS DOUBLE) ELSE 0.0 END AS score, CASE WHEN NOT enough THEN 'insufficient_content' WHEN raw >= 8 THEN 'tight' WHEN raw >= 5 THEN 'mid' ELSE 'padded' END AS verdict,
  {', '.join(f'CASE WHEN enough THEN {k} END AS {k}' for k in prose.PRECISION)}, CASE WHEN enough THEN len(ls) END AS sentences,
  CASE WHEN enough THEN CAST({per['filler_words']} AS DOUBLE) END AS filler_per_1k, CASE WHEN enough THEN CAST(round(ratio * 1000) / 1000 AS DOUBLE) END AS sentence_length_var_ratio,
  CASE WHEN enough THEN CAST(round(word * 100) / 100 AS DOUBLE) END AS avg_word_length_chars, CASE WHEN enough THEN CAST(round(concrete * 100) / 100 AS DOUBLE) END AS concrete_per_100_words
FROM s
"""


_DENSITY = f"""
WITH t AS (SELECT doc_id, round(({' + '.join(f"least({banks.PHRASE_CAP}, {_count('u', p.regex)}) * CAST({banks.CONFIDENCE[p.confidence]} AS DOUBLE)" for p in banks.PHRASES)}) / greatest(1, {_n('b')}) * 1000 * 100) / 100 AS density FROM {S.ASCII_SQL})
SELECT doc_id, density, CASE WHEN density < 3 THEN 'clean' WHEN density < 8 THEN 'suspicious' ELSE 'likely_ai' END AS verdict FROM t
"""


def _signals(bank: list, cap: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT doc_id, {_Q(p.kind)} AS kind, least({cap}, len(regexp_extract_all(u, {_Q(p.regex)}))) AS hits, {_first_pct(p.regex)} AS first_pct, trim(substr(regexp_extract(b, {_Q(p.regex)}, 0), 1, 120)) AS first_snippet FROM t WHERE regexp_matches(u, {_Q(p.regex)})" for p in bank
    )
    return f"WITH t AS MATERIALIZED (SELECT *, greatest(1, {_n('b')}) AS n FROM {S.ASCII_SQL}) {rows}"


def _metatext() -> str:
    parts = []
    for p in banks.ASIDES:
        h, m, z = p.weights or (1.0, 1.0, 1.0)
        # The offset of hit i: tokens of the pieces and hits before it, a split token counted once.
        prefix = f"array_to_string(list_transform(range(1, 2 * i), lambda k: CASE WHEN k % 2 = 1 THEN ps[(k + 1) // 2] ELSE hs[k // 2] END), '')"
        parts.append(
            f"SELECT doc_id, {p.confidence} AS confidence, CASE WHEN pct < 15 THEN {h} WHEN pct > 80 THEN {z} ELSE {m} END AS w FROM (SELECT doc_id, CAST({_n(prefix)} AS DOUBLE) / n * 100 AS pct FROM "
            f"(SELECT doc_id, n, ps, hs, unnest(range(1, least({banks.ASIDE_CAP}, len(hs)) + 1)) AS i FROM (SELECT doc_id, n, string_split_regex(u, {_Q(p.regex)}) AS ps, regexp_extract_all(u, {_Q(p.regex)}) AS hs FROM t WHERE regexp_matches(u, {_Q(p.regex)}))))"
        )
    canonical = ", ".join(map(_Q, banks.CANONICAL_HEADINGS))
    return f"""
WITH t AS MATERIALIZED (SELECT *, greatest(1, {_n('b')}) AS n FROM {S.ASCII_SQL}), hits AS ({' UNION ALL '.join(parts)}
), sums AS (SELECT doc_id, sum(CAST(confidence AS DOUBLE) * CAST(w AS DOUBLE)) AS s, max(confidence) >= {banks.FATAL} AS fatal FROM hits GROUP BY 1
), sk AS (SELECT doc_id, list_distinct(list_filter(list_transform(hs, lambda x: lower(regexp_replace(trim(x), '^[^\\p{{L}}\\p{{N}}]+', ''))), lambda x: x <> '')) AS own FROM {S.TITLES_SQL}
), j AS (SELECT doc_id, list_sort(list_filter(own, lambda x: x IN ({canonical}))) AS matched, len(own) AS k FROM sk
), v AS (SELECT t.doc_id, coalesce(round(s * 1000 / n * 100) / 100, 0) AS density, round(CAST(len(matched) AS DOUBLE) / (k + {len(banks.CANONICAL_HEADINGS)} - len(matched)) * 1000) / 1000 AS jaccard, matched, coalesce(fatal, false) AS fatal FROM t JOIN j USING (doc_id) LEFT JOIN sums USING (doc_id))
SELECT doc_id, CAST(density AS DOUBLE) AS density, jaccard, array_to_string(matched, '|') AS matched,
  CASE WHEN fatal OR (jaccard >= 0.35 AND len(matched) >= 4) OR density > 5 OR (density > 1.5 AND jaccard >= 0.20) THEN 'metatext_heavy' WHEN density > 1.5 THEN 'suspicious' ELSE 'clean' END AS verdict FROM v
"""


_FRESHNESS = rf"""
WITH f AS (SELECT doc_id, b, nullif(regexp_extract(h, '"dateModified"\s*:\s*"([^"]+)"', 1), '') AS m, nullif(regexp_extract(h, '"datePublished"\s*:\s*"([^"]+)"', 1), '') AS p, nullif(regexp_extract(h, 'datetime=''([^'']+)''', 1), '') AS t,
  nullif(regexp_extract(b, '(?i)(?:last\s+updated|reviewed|published)\s*[:.\s]+\s*(?:[A-Z][a-z]{{2}} \d{{1,2}}, \d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}})', 0), '') AS l FROM {S.DATED_SQL}
), d AS (SELECT *, CASE WHEN m LIKE '%T%' THEN CAST(CAST(substr(m, 1, 10) || ' ' || substr(m, 12, 8) AS TIMESTAMP) + INTERVAL 5 HOUR AS DATE) ELSE CAST(m AS DATE) END AS dm, CAST(p AS DATE) AS dp,
  coalesce(CAST(t AS DATE), CASE WHEN regexp_matches(l, '\d{{4}}-\d{{2}}') THEN CAST(regexp_extract(l, '\d{{4}}-\d{{2}}-\d{{2}}', 0) AS DATE) WHEN regexp_matches(l, ',') THEN CAST(strptime(regexp_extract(l, '[A-Z][a-z]{{2}} \d{{1,2}}, \d{{4}}', 0), '%b %-d, %Y') AS DATE) WHEN l IS NOT NULL THEN CAST(regexp_extract(l, '\d{{4}}', 0) || '-01-01' AS DATE) END) AS dv FROM f)
SELECT doc_id, m AS date_modified, p AS date_published, CAST(date_diff('day', coalesce(dm, dp), {AS_OF}) AS INTEGER) AS days_since_modified, t AS time_datetime, l AS visible_updated_label,
  array_to_string(list_sort(list_distinct(regexp_extract_all(b, '\b(19\d{{2}}|20\d{{2}}|21\d{{2}})\b'))), '|') AS years,
  CASE WHEN dm IS NULL THEN 'none' WHEN dv IS NULL THEN CASE WHEN {_n('b')} >= 400 THEN 'severe' ELSE 'none' END WHEN date_diff('day', dv, dm) > 180 THEN 'severe' WHEN date_diff('day', dv, dm) > 30 THEN 'mild' ELSE 'none' END AS severity FROM d
"""


def _design_rules() -> list[tuple[str, str]]:
    """(id, hits) of each line rule over a line x."""

    def groups(k: int, test: str, group: int = 1) -> str:
        return f"len(list_filter(regexp_extract_all(x, {_Q(design.RULES[k].regex)}, {group}), lambda g: {test}))"

    def lined(k: int, test: str) -> str:
        return f"CASE WHEN {test} THEN {_count('x', design.RULES[k].regex)} ELSE 0 END"

    def has(pattern: str) -> str:
        return f"regexp_matches(x, {_Q(pattern)})"

    moved = rf"NOT regexp_matches(lower(g), '\ball\b') AND regexp_matches(lower(g), {_Q(design.SIZED)})"
    rows = {
        0: groups(0, f"CASE WHEN {has(design.ROUNDED)} THEN CAST(g AS INTEGER) >= 1 ELSE CAST(g AS INTEGER) >= 4 END"),
        1: f"CASE WHEN {has(design.SAFE_ELEMENT)} THEN 0 ELSE {groups(1, 'CAST(g AS INTEGER) >= 3')} END",
        2: f"CASE WHEN {has(design.ROUNDED)} THEN {groups(2, 'CAST(g AS INTEGER) >= 1')} ELSE 0 END",
        3: f"CASE WHEN {has(design.BORDER_RADIUS)} THEN {groups(3, 'CAST(g AS INTEGER) >= 3')} ELSE 0 END",
        7: lined(7, has(r"(?i)font-style\s*:\s*italic|\bitalic\b") + " OR " + has(r"#(?:7c2d12|92400e|9a3412|c2410c|d97706|b45309|78350f|fef3c7|fed7aa|fffbeb)\b")),
        8: lined(8, has(r"(?i)#fff(fff)?\b|\bwhite\b")),
        9: lined(9, has(r"\b(text-white|bg-white)\b")),
        10: lined(10, has("(?i)gradient")),
        11: lined(11, has(r"(?i)\bbg-gradient-to-")),
        12: lined(12, has(design.COLOURED)),
        13: lined(13, has(r"(?i)\btext-(?:[2-9]xl|[3-9]xl)\b|<h[1-3]")),
        14: lined(14, has(r"\bto-(?:purple|violet|indigo|blue|cyan|pink|fuchsia)-\d+\b")),
        18: f"len(list_filter(list_zip(regexp_extract_all(x, {_Q(design.RULES[18].regex)}, 2), regexp_extract_all(x, {_Q(design.RULES[18].regex)}, 4)), lambda g: NOT (CAST(g[1] AS DOUBLE) BETWEEN -0.1 AND 1.1 AND CAST(g[2] AS DOUBLE) BETWEEN -0.1 AND 1.1)))",
        19: groups(19, moved),
        20: groups(20, moved),
    }
    return [(r.id, rows.get(k, _count("x", r.regex))) for k, r in enumerate(design.RULES)]


def _design_lines() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {_Q(i)} AS id, sum({hits}) AS k FROM l GROUP BY doc_id" for i, hits in _design_rules())
    return f"WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(h, chr(10))) AS x FROM {S.STYLES_SQL}) SELECT doc_id, id, CAST(sum(k) AS BIGINT) AS hits FROM ({parts}) GROUP BY 1, 2 HAVING sum(k) > 0"


_SPACINGS = f"""list_transform(list_concat(list_filter(list_transform(regexp_extract_all(h, {_Q(design.SPACING_PX)}, 1), lambda v: CAST(v AS BIGINT)), lambda v: v > 0 AND v < 200),
  list_filter(list_transform(regexp_extract_all(h, {_Q(design.SPACING_REM)}, 1), lambda v: CAST(round(CAST(v AS DOUBLE) * 16) AS BIGINT)), lambda v: v > 0 AND v < 200),
  list_transform(regexp_extract_all(h, {_Q(design.SPACING_GAP)}, 1), lambda v: CAST(v AS BIGINT)), list_transform(regexp_extract_all(h, {_Q(design.SPACING_CLASS)}, 1), lambda v: CAST(v AS BIGINT) * 4)), lambda v: v // 4 * 4)"""
_DESIGN_DOCUMENTS = rf"""
WITH s AS MATERIALIZED (SELECT doc_id, h, string_split(h, chr(10)) AS ls, {_SPACINGS} AS vs FROM {S.STYLES_SQL}
), v AS (SELECT doc_id, px, count(*) AS c FROM (SELECT doc_id, unnest(vs) AS px FROM s) GROUP BY 1, 2
), m AS (SELECT doc_id, max_by(px, (c, -px)) AS px, max(c) AS c, sum(c) AS n, count(*) FILTER (px > 0) AS kinds FROM v GROUP BY 1
), f AS (SELECT doc_id, list_distinct(list_filter(flatten(list_transform(regexp_extract_all(h, {_Q(design.FONT_FAMILY)}, 1), lambda x: list_transform(string_split(x, ','), lambda y: lower(trim(trim(y), '"''')))) ), lambda y: y <> '' AND y NOT IN ({', '.join(map(_Q, design.GENERIC_FONTS))}))) AS fs FROM s
), c AS (SELECT doc_id, len(list_filter(ls, lambda x: strlen(trim(x)) > 20 AND regexp_matches(x, {_Q(design.TEXT_ELEMENT)}))) AS t, len(list_filter(ls, lambda x: strlen(trim(x)) > 20 AND regexp_matches(x, {_Q(design.TEXT_ELEMENT)}) AND regexp_matches(x, {_Q(design.CENTERED)}))) AS k FROM s)
SELECT s.doc_id, CASE WHEN len(fs) = 1 AND len(ls) >= 20 THEN 'only font used is ' || fs[1] END AS font,
  CASE WHEN m.n >= 10 AND m.c / m.n > 0.6 AND kinds <= 3 THEN '~' || px || 'px used ' || m.c || '/' || m.n || ' times (' || CAST(round(m.c / m.n * 100) AS INTEGER) || '%)' END AS spacing,
  CASE WHEN t >= 5 AND k / t > 0.7 THEN k || '/' || t || ' text elements centered (' || CAST(round(k / t * 100) AS INTEGER) || '%)' END AS centered
FROM s LEFT JOIN m USING (doc_id) JOIN f USING (doc_id) JOIN c USING (doc_id)
"""


def _design_verdict() -> str:
    return f"""
WITH a AS ({_design_lines()}), d AS ({_DESIGN_DOCUMENTS}), t AS (SELECT doc_id, sum(hits) AS n, count(*) AS kinds FROM a GROUP BY 1
), z AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds, (font IS NOT NULL)::INT + (spacing IS NOT NULL)::INT + (centered IS NOT NULL)::INT AS k FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, CASE WHEN n + k = 0 THEN 'clean' WHEN n + k <= 4 THEN 'minor' WHEN n + k <= 10 THEN 'suspicious' ELSE 'heavy' END AS verdict, CAST(kinds + k AS INTEGER) AS kinds, CAST(least(n, 50) + k AS INTEGER) AS findings FROM z
"""


_HEADING_ORDER = f"""
WITH h AS (SELECT doc_id, i, CASE WHEN i = 0 THEN (doc_id % 9 = 0)::INT + 1 ELSE (doc_id * 3 + i * i) % 4 + 1 END AS level, lower(trim({S.choose_sql('doc_id + i', S.TITLES)})) AS t FROM (SELECT doc_id, unnest(range(0, doc_id % 5 + 2)) AS i FROM documents)
), l AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM h
), v AS (SELECT doc_id, i, CASE WHEN i = 0 AND level > 1 THEN 'First heading is H' || level || ', not H1. Crawlers and screen readers rely on H1 first.' WHEN level > b + 1 THEN 'Heading hierarchy skips: H' || level || ' after H' || b || '. Use consecutive levels.' END AS m FROM l)
SELECT h.doc_id, (SELECT min_by(m, v.i) FROM v WHERE v.doc_id = h.doc_id AND m IS NOT NULL) AS violation, CAST(count(*) - count(DISTINCT t) AS INTEGER) AS duplicates FROM h GROUP BY h.doc_id
"""

_MARKDOWN = r"""
WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN '---' || chr(10) || 'open' || chr(10) ELSE '' END || CASE doc_id % 4 WHEN 0 THEN '# ' WHEN 1 THEN '  ## ' WHEN 2 THEN '### ' ELSE '#### ' END || 'A & B <c>' || chr(13) || chr(10) || chr(10) || text AS m FROM documents
), l AS (SELECT doc_id, list_transform(string_split_regex(m, '\r?\n'), lambda x: replace(replace(replace(regexp_replace(x, '^\s+', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS ls FROM t)
SELECT doc_id, '<!DOCTYPE html><html><head></head><body>' || array_to_string(list_transform(ls, lambda x: CASE WHEN x = '' THEN '' WHEN starts_with(x, '### ') THEN '<h3>' || substr(x, 5) || '</h3>' WHEN starts_with(x, '## ') THEN '<h2>' || substr(x, 4) || '</h2>' WHEN starts_with(x, '# ') THEN '<h1>' || substr(x, 3) || '</h1>' ELSE '<p>' || x || '</p>' END), '') || '</body></html>' AS html FROM l
"""

_UNESCAPE = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _body_text(x: str) -> str:
    x = rf"regexp_replace({x}, '^[\s\S]*?<body[^>]*>', '')"
    x = rf"regexp_replace({x}, '<(script|style|nav|footer|aside)\b[\s\S]*?</(script|style|nav|footer|aside)>|<!--[\s\S]*?-->', ' ', 'g')"
    x = _UNESCAPE.format(x=rf"regexp_replace({x}, '<[^>]*>', ' ', 'g')")
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_PAGE_BODY = rf"""
WITH t AS (SELECT page_id AS doc_id, {_body_text('html')} AS body_text, html FROM pages)
SELECT doc_id, body_text, len(list_filter({_tokens('body_text')}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS word_count,
  trim(regexp_replace({_UNESCAPE.format(x="regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\s+', ' ', 'g')) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM t
"""

_PAGE_META = f"""
SELECT doc_id, trim({_UNESCAPE.format(x="regexp_extract(h, '<title>([^<]*)</title>', 1)")}) AS title, CASE WHEN doc_id % 3 <> 0 THEN CAST(9 * (doc_id % 25) AS INTEGER) END AS n_description, CASE WHEN doc_id % 2 = 0 THEN 'https://shop.example.com/p' END AS canonical,
  CASE doc_id % 4 WHEN 1 THEN '/x.png' WHEN 2 THEN 'https://x.example/i.png' END AS og_image, CASE WHEN doc_id % 4 = 1 THEN 'T' END AS og_title, CASE WHEN doc_id % 2 = 0 THEN 'https://shop.example.com/p/' END AS og_url, CASE WHEN doc_id % 5 = 0 THEN 'Article|Thing' ELSE '' END AS schema_types
FROM {S.PAGES_SQL}
"""

_NAMES = [d for d in page.AUTHORITIES if not d.startswith(".")]
_AUTHORITY = "(" + " OR ".join([f"h IN ({', '.join(map(_Q, _NAMES))})", *[f"suffix(h, {_Q('.' + d)})" for d in _NAMES], *[f"suffix(h, {_Q(d[1:])})" for d in page.AUTHORITIES if d.startswith(".")]]) + ")"
_LINKS = f"""links AS (
  SELECT doc_id, i, {S.choose_sql('doc_id + i * 3', S.HOSTS)} AS href, lower({S.choose_sql('doc_id + i', S.ANCHORS)}) AS t, i % 2 = 0 AS nofollow FROM (SELECT page_id AS doc_id, unnest(range(0, page_id % 7 + 1)) AS i FROM pages)
), kept AS (SELECT *, regexp_replace(nullif(regexp_extract(lower(href), '^(?:https?:)?//([^/?#]+)', 1), ''), '^(?:www\\.)+', '') AS h, nullif(regexp_extract(lower(href), '^(?:https?:)?//([^/?#]+)', 1), '') AS host FROM links WHERE NOT regexp_matches(href, '^#|^javascript:')
), marked AS (SELECT *, CASE WHEN host IS NULL OR (doc_id % 2 = 0 AND h = 'shop.example.com') THEN 'internal' ELSE 'external' END AS kind, coalesce({_AUTHORITY}, false) AS auth FROM kept)"""
_PAGE_LINKS = f"""
WITH {_LINKS}
SELECT p.page_id AS doc_id, CAST(count(kind) AS INTEGER) AS total, CAST(count(*) FILTER (kind = 'internal') AS INTEGER) AS internal, CAST(count(*) FILTER (kind = 'external') AS INTEGER) AS "external", CAST(count(*) FILTER (kind = 'external' AND nofollow) AS INTEGER) AS nofollow_external,
  CAST(count(*) FILTER (kind = 'external' AND auth) AS INTEGER) AS authority_external, CAST(count(DISTINCT host) FILTER (kind = 'external') AS INTEGER) AS external_hosts, CAST(count(*) FILTER (t IN ({', '.join(map(_Q, page.GENERIC_ANCHORS))}, '')) AS INTEGER) AS generic_anchor_text
FROM pages p LEFT JOIN marked m ON m.doc_id = p.page_id GROUP BY 1
"""
_AUTHORITY_LINKS = f"WITH {_LINKS} SELECT host, count(*) AS links FROM kept WHERE host IS NOT NULL AND {_AUTHORITY} GROUP BY 1"

_PERFORMANCE = r"""
SELECT doc_id, CAST(n AS INTEGER) AS total, CAST((SELECT count(*) FROM range(3, n + 1) r(i) WHERE i % 2 = 0) AS INTEGER) AS eligible_for_lazy_missing, CAST((n + 1) // 2 AS INTEGER) AS missing_dimensions, CAST(n AS INTEGER) AS non_descriptive_filenames,
  0 AS modern_format_via_picture, CAST(n // 2 AS INTEGER) AS modern_format_via_src, CAST((doc_id % 6 = 0) AS INTEGER) AS head_scripts_blocking, CAST((doc_id % 6 = 0) AS INTEGER) AS head_stylesheets, CAST((doc_id % 6 = 0) AS INTEGER) AS preload, CAST((doc_id % 6 = 0) AS INTEGER) AS font_links,
  CAST(strlen(regexp_extract(h, '<style>([^<]*)</style>', 1)) AS BIGINT) AS inline_css, CAST(strlen(regexp_extract(h, '<script>([\s\S]*?)</script>', 1)) + CASE WHEN doc_id % 5 = 0 THEN strlen('{"@graph":[{"@type":["Article","Thing"],"dateModified":"2024-01-15"}]}') ELSE 0 END AS BIGINT) AS inline_js
FROM (SELECT *, doc_id % 6 + 1 AS n FROM PAGES)
""".replace("PAGES", S.PAGES_SQL)


def _audit_base() -> str:
    """Rows (doc_id, facts of the sample pages) that the rules of metadata, previews and structure need."""
    return f"""
p AS MATERIALIZED (SELECT doc_id, h, {_body_text('h')} AS b FROM {S.PAGES_SQL}
), u AS MATERIALIZED (SELECT *, regexp_replace(b, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '_', 'g') AS u, len(list_filter({_tokens('b')}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS words, {_n('b')} AS n FROM p
), lk AS (SELECT page_id AS doc_id, len(list_filter(range(0, page_id % 7 + 1), lambda i: {S.choose_sql('page_id + i', S.ANCHORS)} IN ('Click here', 'read more', '') AND NOT regexp_matches({S.choose_sql('page_id + i * 3', S.HOSTS)}, '^#|^javascript:'))) AS generic FROM pages
), x AS (SELECT u.*, generic, doc_id % 6 + 1 AS images, CASE WHEN doc_id % 3 <> 0 THEN 9 * (doc_id % 25) END AS nd, CASE doc_id % 4 WHEN 1 THEN '/x.png' WHEN 2 THEN 'https://x.example/i.png' END AS img, doc_id % 5 = 0 AS article,
  CASE WHEN doc_id % 5 = 0 THEN date_diff('day', DATE '2024-01-15', {AS_OF}) END AS days,
  {_first_pct(prose.ANSWER_BLOCK)} AS tldr, {_first_pct(prose.POSITION_STATISTIC)} AS stat,
  round(({' + '.join(f"least({banks.PHRASE_CAP}, {_count('u', q.regex)}) * CAST({banks.CONFIDENCE[q.confidence]} AS DOUBLE)" for q in banks.PHRASES)}) / greatest(1, n) * 1000 * 100) / 100 AS slop,
  least(10, {' + '.join(_count('u', prose.ORIGINALITY[k]) for k in prose.SAMPLE_KINDS)} + least(5, {_count('u', prose.ORIGINALITY['numbered_citations'])})) AS gain FROM u JOIN lk USING (doc_id))"""


_COMPONENTS = [
    ("meta_description", 10, "nd IS NULL"),
    ("og_title", 5, "doc_id % 4 <> 1"),
    ("og_image", 10, "img IS NULL"),
    ("og_image_url", 8, "img = '/x.png'"),
    ("og_image_dimensions", 2, "doc_id % 4 = 2"),
    ("twitter_card", 2, "img IS NOT NULL"),
    ("h2_count", 5, "true"),
    ("word_count", 10, "words < 300"),
    ("tldr", 2, "tldr IS NULL AND words >= 150"),
    ("schema", 5, "NOT article"),
    ("tldr_position", 5, "tldr > 10"),
    ("first_stat_position", 5, "stat > 30"),
    ("img_alt", 5, "true"),
    ("ai_slop", 5, "slop >= 3 AND slop < 8"),
    ("ai_slop", 15, "slop >= 8"),
    ("information_gain", 10, "words >= 300 AND gain <= 1"),
    ("information_gain", 5, "words >= 300 AND gain BETWEEN 2 AND 4"),
]
_AUDIT_SCORES = f"""
WITH {_audit_base()}
SELECT doc_id, CAST(greatest(0, 100 - ({' + '.join(f'CASE WHEN {t} THEN {k} ELSE 0 END' for _, k, t in _COMPONENTS)})) AS INTEGER) AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {t} THEN {_Q(f'{n}:{k}')} END" for n, k, t in _COMPONENTS)}], lambda c: c IS NOT NULL), '|') AS components FROM x
"""

_MESSAGES = [
    ("desc_absent", "meta", "nd IS NULL", "'Meta description absent. 150..160 chars.'"),
    ("desc_short", "meta", "nd < 100", "'Meta description is ' || nd || ' chars. Aim 150..160.'"),
    ("desc_long", "meta", "nd > 170", "'Meta description is ' || nd || ' chars. Snippets truncate past 160.'"),
    ("og_title_absent", "og", "doc_id % 4 <> 1", "'og:title absent.'"),
    ("og_image_absent", "og", "img IS NULL", "'og:image absent. Shares and AI-citation previews render bare. Ship 1200×630 (1.91:1), absolute https URL.'"),
    ("og_image_relative", "og", "img = '/x.png'", "'og:image is not an absolute URL (`/x.png`). Crawlers resolve it against nothing — the preview silently fails everywhere. Use the full https URL.'"),
    ("og_image_dims", "og", "doc_id % 4 = 2", "'og:image:width/height absent. The first share of any page renders imageless while the crawler fetches the file — declare 1200 and 630.'"),
    ("og_image_alt", "og", "doc_id % 4 = 2", "'og:image:alt absent. Screen readers and multimodal retrieval read it.'"),
    ("og_description_absent", "og", "img IS NOT NULL", "'og:description absent. Platforms fall back to the meta description; AI previews may show arbitrary page text instead.'"),
    ("twitter_card_absent", "og", "img IS NOT NULL", "'twitter:card absent. X falls back to OG for text and image but renders the small card — add `twitter:card=summary_large_image`.'"),
    ("og_type_absent", "og", "article", "'og:type absent on an Article page. Declare `og:type=article`.'"),
    ("canonical_absent", "meta", "doc_id % 2 = 1", "'Canonical link absent. Without it, near-duplicate URLs dilute Google''s index and confuse downstream retrieval.'"),
    ("viewport_absent", "meta", "true", "'Viewport meta absent. Mobile rendering breaks; Google indexes mobile-first.'"),
    ("h2_few", "content", "true", "'1 H2s in main content. H2s act as passage anchors for AI retrieval; one or zero H2s makes the page hard to chunk.'"),
    ("img_alt_missing", "content", "true", "(images + 1) // 2 || ' images missing alt text. Multimodal AI search reads alt.'"),
    ("jsonld_absent", "schema", "NOT article", "'No JSON-LD. Article + Organization at minimum; FAQ for question pages.'"),
    ("stale_90", "freshness", "days > 90", "'Last modified ' || days || ' days ago. If the topic moves, refresh and update dateModified.'"),
    ("perf_lazy", "content", "images >= 4", "images // 2 - 1 || ' below-the-fold image' || CASE WHEN images // 2 = 2 THEN '' ELSE 's' END || ' without `loading=\"lazy\"`. Lazy-load every image past the first two to cut initial bytes.'"),
    ("perf_dims", "content", "true", "(images + 1) // 2 || ' of ' || images || ' `<img>` missing width/height. CLS risk unless reserved via CSS `aspect-ratio` / fixed-size container.'"),
    ("perf_blocking_script", "content", "doc_id % 6 = 0", "'1 render-blocking `<script>` in `<head>` (no async/defer/type=module). Each one delays first paint.'"),
    ("perf_font_display", "content", "doc_id % 6 = 0", "'External fonts present but no `font-display: swap|optional|fallback` declared. Invisible text during font load (FOIT) on slow networks.'"),
    ("perf_lcp_preload", "content", "true", "'No `<link rel=\"preload\" as=\"image\">` for the LCP image. Browser discovers the hero image only after the HTML parser reaches it.'"),
    ("link_generic", "content", "generic >= 3", "generic || ' generic anchor texts (\"click here\", \"read more\", \"link\"). Anchor text is topic signal — use descriptive phrases.'"),
    ("date_mismatch_severe", "freshness", "article AND n >= 400", "'Schema dateModified is severely out of sync with visible signals (gap >180 days, or no visible date at all on long content). Refresh visible dates alongside the schema, not just the schema.'"),
]
_FOUND = f"WITH {_audit_base()} " + " UNION ALL ".join(f"SELECT doc_id, {_Q(i)} AS rule_id, {_Q(f)} AS factor, {m} AS message FROM x WHERE {t}" for i, f, t, m in _MESSAGES)
_FACTORS = f"SELECT rule_id, count(*) AS documents FROM ({_FOUND}) WHERE regexp_matches(lower(message), 'og:|og_|open graph|twitter:card|schema|json-ld') GROUP BY 1"

_VERIFY = f"""
WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS file, hs AS x FROM {S.TITLES_SQL} WHERE doc_id % 10 <> 0), b AS (SELECT CAST(doc_id + 3 AS VARCHAR) AS file, hs AS y FROM {S.TITLES_SQL}
), j AS (SELECT file, x IS NOT NULL AS o, y IS NOT NULL AS w, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN b USING (file)
), d AS (SELECT *, list_sort(list_distinct(list_filter(x, lambda m: NOT list_contains(y, m)))) AS f, list_sort(list_distinct(list_filter(y, lambda m: NOT list_contains(x, m)))) AS r, list_sort(list_distinct(list_filter(x, lambda m: list_contains(y, m)))) AS s FROM j)
SELECT file, CASE WHEN w THEN 70 ELSE 0 END - CASE WHEN o THEN 60 ELSE 0 END AS score_change, array_to_string(f, '|') AS fixed, array_to_string(r, '|') AS regressed, array_to_string(s, '|') AS still_present, CASE WHEN len(s) = 0 AND len(r) = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM d
"""
_VERIFY_LONG = f"""
WITH a AS (SELECT DISTINCT doc_id, unnest(hs) AS m FROM {S.TITLES_SQL}), b AS (SELECT DISTINCT doc_id + 3 AS doc_id, unnest(hs) AS m FROM {S.TITLES_SQL})
SELECT CASE WHEN b.m IS NULL THEN 'fixed' WHEN a.m IS NULL THEN 'regressed' ELSE 'still_present' END AS status, count(*) AS findings FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.m = b.m GROUP BY 1
"""

_HEADERS = """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'noindex' WHEN 1 THEN 'nofollow, noindex' WHEN 2 THEN 'nofollow;noarchive' WHEN 3 THEN 'none' WHEN 4 THEN 'all' WHEN 5 THEN 'noai , noimageindex' WHEN 6 THEN 'max-snippet:5' ELSE '' END AS r, CAST(o_orderkey % 6 * 100 + o_orderkey % 40 AS INTEGER) AS s FROM orders
), t AS (SELECT k, s, list_transform(string_split_regex(r, '[,;]'), lambda x: trim(x)) AS ts FROM r)
SELECT k AS doc_id, array_to_string(list_filter([CASE WHEN list_has_any(ts, ['noindex', 'none']) THEN 'xrobots_noindex' END, CASE WHEN list_contains(ts, 'nofollow') AND NOT list_contains(ts, 'noindex') THEN 'xrobots_nofollow' END, CASE WHEN list_contains(ts, 'noimageindex') THEN 'xrobots_noimageindex' END, CASE WHEN list_has_any(ts, ['noai', 'noimageai']) THEN 'xrobots_noai' END,
  CASE WHEN k % 3 <> 0 AND k * 7 > 50000 THEN 'no_compression' END], lambda x: x IS NOT NULL), '|') AS rules, CASE WHEN s >= 500 THEN 'transient' WHEN s = 429 THEN 'rate_limited' WHEN s >= 400 THEN 'bad_input' ELSE 'ok' END AS status_class FROM t
"""
_PROBE = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 1500 + 1 END AS width, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 900 + 1 END AS height, o_orderkey % 3 < 2 AS is_image FROM orders"
_IMAGE_RULES = """
WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 1500 + 1 END AS w, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 900 + 1 END AS h, CASE WHEN o_orderkey % 5 = 0 THEN 404 WHEN o_orderkey % 7 <> 0 THEN 200 END AS s FROM orders)
SELECT k AS doc_id, CASE WHEN s IS NULL THEN '' WHEN s = 404 THEN 'og_image_http_error' ELSE array_to_string(list_filter([CASE WHEN w IS NULL THEN 'og_image_not_image' END, CASE WHEN w < 200 OR h < 200 THEN 'og_image_tiny' WHEN w < 600 THEN 'og_image_small' WHEN w < 1200 THEN 'og_image_soft' END, CASE WHEN h > w THEN 'og_image_portrait' END, CASE WHEN w <> 1200 THEN 'og_image_declared_mismatch' END], lambda x: x IS NOT NULL), '|') END AS rules FROM d
"""


def oracle_sql() -> dict[str, str]:
    scores = "(SELECT doc_id, source, lang, CAST(greatest(0, 100 - doc_id * 37 % 83) AS INTEGER) AS score FROM documents)"
    return {
        "word_counts": rf"SELECT doc_id, {_n('b')} AS n_ws, len(list_filter({_tokens('b')}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS n_words FROM {S.PLAIN_SQL}",
        "sentence_stats": rf"SELECT doc_id, len(list_filter({_sentences('b')}, lambda s: {_n('s')} BETWEEN 5 AND 25)) AS quotable, coalesce(CAST(round(list_avg(list_filter(list_transform({_sentences('b')}, lambda s: {_n('s')}), lambda k: k > 0))) AS INTEGER), 0) AS avg_words FROM {S.PLAIN_SQL}",
        "keyword_counts": _KEYWORD_COUNTS,
        "keywords": _KEYWORDS_SQL,
        "people": _PEOPLE,
        "organizations": _ORGANIZATIONS,
        "organizations_by_row": _ORGS_BY_ROW,
        "evidence": _EVIDENCE,
        "snippet_candidate": _SNIPPET,
        "position_bias": _POSITION,
        "information_gain": _GAIN,
        "copy_precision": _copy(),
        "ai_slop_density": _DENSITY,
        "ai_slop_signals": _signals(banks.PHRASES, banks.PHRASE_CAP),
        "metatext_signals": _signals(banks.ASIDES, banks.ASIDE_CAP),
        "metatext_verdict": _metatext(),
        "freshness_dates": _FRESHNESS,
        "design_line_hits": _design_lines(),
        "design_documents": _DESIGN_DOCUMENTS,
        "design_verdict": _design_verdict(),
        "heading_order": _HEADING_ORDER,
        "markdown_lite": _MARKDOWN,
        "page_metadata": _PAGE_META,
        "page_body_text": _PAGE_BODY,
        "page_links": _PAGE_LINKS,
        "authority_links": _AUTHORITY_LINKS,
        "page_performance": _PERFORMANCE,
        "audit_scores": _AUDIT_SCORES,
        "rule_findings": _FOUND,
        "factor_filter": _FACTORS,
        "verify_diff": _VERIFY,
        "verify_long": _VERIFY_LONG,
        "header_rules": _HEADERS,
        "image_probe": _PROBE,
        "image_rules": _IMAGE_RULES,
        "jsonld": "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'https://x.example/' || c_custkey END AS url, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS same_as, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS answer, CASE WHEN c_custkey % 4 <> 0 THEN 'b::c' END AS second FROM customer",
        "jsonld_documents": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '2024-02-02' ELSE '2024-01-01' END AS modified, o AS suffix, o AS publisher, CASE WHEN c_custkey % 5 = 0 THEN 'https://x.example' END AS page, '2' AS position, c_mktsegment AS step, o AS employer,
  '@context,@type,headline,description,datePublished,dateModified,author' || CASE WHEN o IS NOT NULL THEN ',publisher' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN ',mainEntityOfPage' ELSE '' END || CASE WHEN o IS NOT NULL THEN ',image' ELSE '' END || ',@context,@type,name,step' || CASE WHEN o IS NOT NULL THEN ',description' ELSE '' END || ',@context,@type,name' || CASE WHEN o IS NOT NULL THEN ',jobTitle,worksFor' ELSE '' END AS keys
  FROM (SELECT *, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS o FROM customer)""",
        "sarif_results": f"SELECT 'doc-' || doc_id AS uri, 'warning' AS level, unnest(hs) AS text FROM {S.TITLES_SQL}",
        "score_histogram": f"SELECT CAST(score // 10 * 10 AS BIGINT) AS bucket, count(*) AS documents FROM {scores} GROUP BY 1",
        "score_rank": f"SELECT doc_id, source, score, rank() OVER (PARTITION BY source ORDER BY score DESC) AS rank, rank() OVER (PARTITION BY source ORDER BY score DESC) / count(*) OVER (PARTITION BY source) AS share FROM {scores}",
        "quality_gate": f"SELECT doc_id, score FROM {scores} WHERE score < 60",
        "rule_prevalence": f"SELECT rule_id, CAST(length(rule_id) % 3 AS INTEGER) AS factor, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(hs) AS rule_id FROM {S.TITLES_SQL}) GROUP BY 1, 2",
        "findings_rollup": f"SELECT lang, rule_id, count(*) AS findings FROM (SELECT lang, unnest(hs) AS rule_id FROM {S.TITLES_SQL} JOIN documents USING (doc_id)) GROUP BY ROLLUP (lang, rule_id)",
        "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM k GROUP BY user_id, i",
    }
