"""The registered queries of this subpackage and their SQL, for the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scans import read_table
from . import chat, decontaminate, language_id, licenses, near_dups, packing, quality, revisits, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _fold(parts: int) -> F.Column:
    """A doc_id's share of ``parts``; a null one counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("identifiers", "licenses", "unmatched")])


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null").where(_fold(5) != 0)
    # Labels grow with the corpus, so they are never broadcast; the hash table is built on them, and texts aren't sorted.
    labelled = docs.where(_fold(5) != 0).join(labels.hint("shuffle_hash"), "doc_id")
    model = toxicity.fit(labelled, calibrate=_fold(15) == 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(_captures(_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "response_id", "outcome", headers.alias("headers"))


def _captures(pages: DataFrame) -> DataFrame:
    """Two capture records of each page: a full response (one in eleven an error) and a revisit."""
    p, tag = F.col("page_id"), F.md5("html")

    def headers(**fields) -> F.Column:
        return F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda _, v: v.isNotNull())

    modified = F.when(p % 2 == 0, F.concat(F.lit("d"), p % 1000))
    rows = pages.select("page_id", "url", "html")
    full = rows.select(
        (p * 2).alias("record_id"),
        "url",
        (p * 60).alias("ts"),
        F.lit("response").alias("type"),
        F.when(p % 11 == 0, 503).otherwise(200).alias("status"),
        headers(etag=F.when(p % 4 != 0, F.concat(F.lit('"'), tag, F.lit('"'))), last_modified=modified, content_type=F.lit("text/html")).alias("headers"),
        tag.alias("digest"),
    )
    again = rows.select(
        (p * 2 + 1).alias("record_id"),
        F.concat(F.lit("HTTPS://www."), F.regexp_replace("url", "^https?://", ""), F.lit("#again")).alias("url"),
        (p * 60 + (p % 5) * 100_000 - 50_000).alias("ts"),
        F.lit("revisit").alias("type"),
        F.lit(304).alias("status"),
        headers(etag=F.when(p % 7 == 0, F.lit('"x"')).when(p % 4 > 1, F.concat(F.lit('W/"'), tag, F.lit('"'))), last_modified=modified, cache_control=F.concat(F.lit("max-age="), p % 100), content_type=F.lit("x/ignored")).alias("headers"),
        F.when(p % 3 == 0, tag).alias("digest"),
    )
    return full.unionByName(again)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learn=_fold(4) != 2)
    found = language_id.identify(docs, model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT bigint(-1) conv_id, bigint(turn) turn, role, r'</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(rows)
    out = out.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    names = [op1_license_scan, op2_minhash_near_dups, op3_quality_rules, op4_suffix_dedup, op5_toxicity, op6_warc_revisits, op7_language_id, op8_lexical_packing, op9_decontamination, op10_chat_formatting, pipeline]
    return {f.__name__: f for f in names}


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, {words} AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.sh) + len(b.sh) - c)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s
  UNION SELECT r.a, CASE WHEN l.x = r.b THEN l.y ELSE l.x END FROM reach r JOIN links l ON l.x = r.b OR l.y = r.b
)
SELECT doc_id, CAST(len(any_value(sh)) AS BIGINT) AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept
FROM s JOIN reach ON a = doc_id GROUP BY doc_id
"""

_OP3 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {words} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1
), rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY 1
), m AS (
  SELECT w.doc_id, source AS host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (SELECT host, count(*) AS n, {counts} FROM b WHERE host IS NOT NULL GROUP BY host
), p AS (SELECT {prior} FROM h
), v AS (SELECT host, {failed} AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM b LEFT JOIN v USING (host)
"""


def _op3_sql() -> str:
    low, high = quality.WEIGHT
    counts, prior, failed = [], [], []
    for name, (rule, limit) in quality.RULES.items():
        counts.append(f"count(*) FILTER ({rule}) AS {name}_f")
        prior.append(f"avg({name}_f / n) AS {name}_m, var_pop({name}_f / n) AS {name}_v")
        weight = f"(CASE WHEN {name}_v > 0 THEN greatest({low}, least({high}, {name}_m * (1 - {name}_m) / {name}_v - 1)) ELSE {high} END)"
        failed.append(f"({name}_f + {weight} * {name}_m) / (n + {weight}) > {limit}")
    return _OP3.format(words=_WORDS.format(text="coalesce(text, '')"), counts=", ".join(counts), prior=", ".join(prior), failed=" OR ".join(failed))


_OP4 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM h)
), f AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), k AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM w JOIN f USING (s) WHERE d < doc_id
), i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM k
), r AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY 1, 2
), t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM r
), c AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM t JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN c USING (doc_id)
"""

_OP6 = r"""
WITH base AS (SELECT page_id AS p, url, md5(html) AS tag, CASE WHEN page_id % 2 = 0 THEN 'd' || (page_id % 1000) END AS modified FROM pages
), records AS (
  SELECT p * 2 AS record_id, url, p * 60 AS ts, 'response' AS type, CASE WHEN p % 11 = 0 THEN 503 ELSE 200 END AS status,
    CASE WHEN p % 4 <> 0 THEN '"' || tag || '"' END AS etag, modified, 'text/html' AS ctype, CAST(NULL AS VARCHAR) AS cache, tag AS digest FROM base
  UNION ALL
  SELECT p * 2 + 1, 'HTTPS://www.' || regexp_replace(url, '^https?://', '') || '#again', p * 60 + (p % 5) * 100000 - 50000, 'revisit', 304,
    CASE WHEN p % 7 = 0 THEN '"x"' WHEN p % 4 > 1 THEN 'W/"' || tag || '"' END, modified, 'x/ignored', 'max-age=' || (p % 100), CASE WHEN p % 3 = 0 THEN tag END FROM base
), bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?:)?//', '') AS u FROM records
), parts AS (SELECT *, lower(regexp_extract(u, '^([^/?]*)', 1)) AS host0, substr(u, length(regexp_extract(u, '^([^/?]*)', 1)) + 1) AS rest FROM bare
), cut AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host0, '^.*@', ''), '^www\.', ''), ':(?:80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^{tracking}(?:=|$)'))) AS q FROM parts
), c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM cut
), r AS (SELECT * FROM c WHERE type = 'revisit'), f AS (SELECT * FROM c WHERE type = 'response' AND status = 200
), m AS (
  SELECT r.record_id, r.canonical_url, r.etag, r.modified, r.ctype, r.cache, r.digest,
    (SELECT max_by(f.record_id, (f.ts, f.record_id)) FROM f WHERE f.canonical_url = r.canonical_url AND f.ts < r.ts) AS response_id FROM r
), o AS (
  SELECT m.*, f.etag AS fe, f.modified AS fm, f.digest AS fd, CASE WHEN response_id IS NULL THEN 'orphan'
    WHEN m.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN regexp_replace(m.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
    WHEN m.modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN m.modified = f.modified THEN 'resolved' ELSE 'mismatch' END
    WHEN m.digest IS NOT NULL AND f.digest IS NOT NULL THEN CASE WHEN m.digest = f.digest THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unchecked' END AS outcome FROM m LEFT JOIN f ON f.record_id = response_id
), x AS (SELECT *, outcome IN ('resolved', 'unchecked') AS ok FROM o)
SELECT record_id, canonical_url, response_id, outcome, array_to_string(list_sort(list_filter([
  'cache-control=' || cache, 'content-type=' || CASE WHEN ok THEN 'text/html' ELSE ctype END,
  'etag=' || CASE WHEN ok THEN coalesce(etag, fe) ELSE etag END, 'last-modified=' || CASE WHEN ok THEN coalesce(modified, fm) ELSE modified END], lambda y: y IS NOT NULL)), ';') AS headers FROM x
"""

#: Aligns tokens on every diagonal with enough equal ones; of items of six tokens or more, as all of the table have.
_OP9 = r"""
WITH t AS (
  SELECT doc_id, unnest(ts) AS tok, unnest(range(len(ts))) AS p, len(ts) AS n
  FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents)
), b AS (
  SELECT item_id, unnest(ts) AS tok, unnest(range(len(ts))) AS q, len(ts) AS m
  FROM (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM benchmark) WHERE len(ts) >= 6
), hit AS (SELECT doc_id, item_id, m, n, p - q AS d, list(q ORDER BY q) AS qs FROM t JOIN b USING (tok) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= least(10, m - 2)
), cell AS (
  SELECT doc_id, item_id, m, d, greatest(0, -d) AS a, least(m, n - d) AS e, i, CASE WHEN list_contains(qs, i) THEN 1 ELSE -3 END AS v
  FROM (SELECT *, unnest(range(greatest(0, -d), least(m, n - d))) AS i FROM hit)
), total AS (SELECT *, sum(v) OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS s, sum(CASE WHEN v = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id, d) AS same FROM cell
), low AS (SELECT *, least(0, min(s) OVER (PARTITION BY doc_id, item_id, d ORDER BY i)) AS l FROM total
), top AS (SELECT doc_id, item_id, d, any_value(m) AS m, any_value(a) AS a, any_value(e) - any_value(a) AS whole, any_value(same) AS same, max(s - l) AS score, arg_min(i, (l - s, i)) AS last FROM low GROUP BY 1, 2, 3
), begun AS (SELECT doc_id, item_id, d, min(s) AS least, arg_min(i, (s, i)) + 1 AS i1 FROM total JOIN top USING (doc_id, item_id, d) WHERE i <= last GROUP BY 1, 2, 3
), run AS (SELECT *, last - i0 + 1 AS length FROM (SELECT top.*, CASE WHEN least >= 0 THEN top.a ELSE i1 END AS i0 FROM top JOIN begun USING (doc_id, item_id, d))
), got AS (
  SELECT doc_id, item_id, CASE WHEN length >= least(13, m) THEN d + i0 ELSE d END AS token, CASE WHEN length >= least(13, m) THEN length ELSE m END AS n_tokens,
    CASE WHEN length >= least(13, m) THEN (length - score) // 4 ELSE m - same END AS n_substituted
  FROM run WHERE length >= least(13, m) OR whole = m AND m - same <= 1 + CAST(m >= 16 AS INT)
)
SELECT doc_id, item_id, CAST(token AS BIGINT) AS token, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_substituted AS BIGINT) AS n_substituted
FROM got QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_tokens - n_substituted DESC, token, n_tokens DESC) = 1
"""

_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|(?:SYS|INST|TOOL)\])|ROLE|/ROLE\])', '\1\\\2', 'g')) AS n FROM c
), d AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 9 WHEN 'tool' THEN 15 ELSE NULL END) AS BIGINT) AS formatted_chars,
  bool_and(before || ' ' || role IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user', 'assistant tool', 'tool assistant'))
    AND max_by(role, turn) = 'assistant' AS valid
FROM d GROUP BY conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The steps of ``licenses.LINES`` without look-around; copyright lines follow.
_OP1_LINES = [
    (r"(spdx-license-identifier):", r"\1"),
    (r"[ \t]+", " "),
    (r"\r?\n[ /#*;%-]*", "\n"),
    (r"([.!?;:])(?: ?\n| )", "\\1\f"),
    (r"""(^|[\n\f])[ /#*;%"'-]+""", r"\1"),
    (r"""[ .!?;:"'*/]+([\n\f]|$)""", r"\1"),
    (r"""[,:"'`]""", ""),
    (r" +", " "),
    (r" ?\n[ \n]*", "\n"),
]


def _op1_sql() -> str:
    text = "lower(text)"
    for pattern, by in _OP1_LINES:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    # Each line and sentence end is doubled, so that two neighbours can take one each.
    known = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in licenses.SENTENCES.items()) + "}"
    pattern = _quoted(rf"[\n\f]({licenses.sentence_pattern('(?: |\n\n)')})[\n\f]")
    holder = _quoted(r"^(?:copyright|\(c\))[ \n](?:[^\f]*[ \n])?(?:\(c\)|[0-9]{4})")
    names = f"string_split_regex(trim(regexp_replace(substr(x, {len(licenses.TAG) + 2}), '[() ]+', ' ', 'g')), ' (?:and|or|with) ')"
    rules = ", ".join(f"{{'l': {_quoted(' ' + '  '.join(ids) + ' ')}, 'names': [{_quoted(name)}]}}" for name, ids in licenses.RULES)
    start = "{'l': ' ' || array_to_string(ids, '  ') || ' ', 'names': []::VARCHAR[]}"
    taken = "CASE WHEN contains(a.l, r.l) THEN {'l': replace(a.l, r.l, ' | '), 'names': list_concat(a.names, r.names)} ELSE a END"
    return f"""
WITH n AS (SELECT doc_id, {text} AS t FROM documents WHERE regexp_matches(lower(text), '{licenses.HINTS}')
), s AS (SELECT doc_id, list_transform(list_transform(string_split(t, chr(12)), lambda x: string_split(x, chr(10))),
    lambda ls: array_to_string(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(array_to_string(ls[i:], chr(10)), {holder}) THEN 'copyright' ELSE x END), chr(10) || chr(10))) AS ss FROM n
), m AS (SELECT doc_id, regexp_extract_all(chr(10) || array_to_string(ss, chr(12) || chr(12)) || chr(10), {pattern}, 1) AS ms FROM s
), found AS (SELECT doc_id, ids FROM (SELECT doc_id, flatten(list_transform(ms, lambda x: CASE WHEN starts_with(x, '{licenses.TAG}')
    THEN list_transform([{names}], lambda ns: CASE WHEN len(list_filter(ns, lambda z: z = '' OR contains(z, ' '))) = 0 THEN list_transform(ns, lambda y: 'spdx:' || y) ELSE [] END)[1]
    ELSE string_split({known}[replace(x, chr(10) || chr(10), ' ')], ' ') END)) AS ids FROM m) WHERE len(ids) > 0)
SELECT doc_id, array_to_string(ids, ' ') AS identifiers, array_to_string(list_sort(list_distinct(e.names)), ' ') AS licenses,
  array_to_string(list_filter(string_split_regex(e.l, '[ |]+'), lambda x: x <> ''), ' ') AS unmatched
FROM (SELECT doc_id, ids, list_reduce(list_prepend({start}, [{rules}]), lambda a, r: {taken}) AS e FROM found)
"""


def oracle_sql() -> dict[str, str]:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return {
        "op1_license_scan": _op1_sql(),
        "op2_minhash_near_dups": _OP2.format(words=_WORDS.format(text=lowered)),
        "op3_quality_rules": _op3_sql(),
        "op4_suffix_dedup": _OP4,
        "op6_warc_revisits": _OP6.format(tracking=revisits.TRACKING),
        "op9_decontamination": _OP9,
        "op10_chat_formatting": _OP10,
    }
