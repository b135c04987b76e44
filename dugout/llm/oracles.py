"""SQL with the results of those queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


NGRAM_JACCARD = rf"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles
  FROM cut),
flat AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 85 * (a.n + b.n - COUNT(*))),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT doc_id, any_value(len(shingles))::BIGINT AS n_shingles, MIN(other) AS component_id
FROM reached JOIN sets USING (doc_id) GROUP BY doc_id"""


def _host(url: str) -> str:
    return _lowered(f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1)")


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _rule(url: str, wanted: str) -> str:
    return (
        f"(SELECT max_by({wanted}, length(rule)) FROM rules WHERE ({_host(url)} = rule_host OR ends_with({_host(url)}, '.' || rule_host))"
        f" AND starts_with({_path(url)}, rule_path))"
    )


_BARE = "regexp_replace(trim({u}), '(?s)#.*$', '')"


def _key(url: str) -> str:
    bare = _BARE.format(u=url)
    return (
        f"CASE WHEN contains({bare}, '://') THEN lower(regexp_extract({bare}, '(?s)^(.*?)://', 1)) || '://' || {_host(bare)}"
        f" || regexp_extract({bare}, '(?s)^.*?://[^/?]*(.*)$', 1) ELSE {bare} END"
    )


URL_REDIRECTS = rf"""
WITH RECURSIVE rules AS (
  SELECT verdict, rule_host, rule_path, rule_host || rule_path AS rule
  FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
    AS t(verdict, rule_host, rule_path)),
tags AS (
  SELECT url AS base, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
targets AS (
  SELECT base, replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    END, '&amp;', '&') AS target FROM tags),
whole AS (
  SELECT base, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(base, '(?s)^(.*?)://', 1) || ':' || target
    WHEN starts_with(target, '/') THEN regexp_extract(base, '(?s)^(.*?://[^/?#]*)', 1) || target
    ELSE rtrim(regexp_extract(base, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') || '/' || target END AS target
  FROM targets WHERE target <> ''),
edges AS (SELECT DISTINCT {_key('base')} AS u, {_key('target')} AS v FROM whole),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached(url, other) AS (SELECT u, u FROM ways UNION SELECT r.url, w.v FROM reached r JOIN ways w ON w.u = r.other),
stained AS (SELECT DISTINCT url AS stain FROM reached WHERE {_rule('other', 'verdict')} = 'block')
SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_rule('url', 'rule')} AS rule,
  coalesce({_rule('url', 'verdict')}, CASE WHEN stain IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM pages LEFT JOIN stained ON stain = {_key('url')}"""

WARC_DICTIONARY = """
SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT page_id, payload, CASE WHEN strlen(payload) >= 100 AND page_id <> first THEN first END AS refers_to
      FROM (SELECT page_id, coalesce(html, '') AS payload, MIN(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))"""


def _escaped_length(text: str) -> str:
    return rf"(length({text}) + length(regexp_replace({text}, '[^<\[\]\\]', '', 'g')))"


CHAT_PARTS = f"""
WITH messages AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role))
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + SUM(14 + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM messages GROUP BY conv_id"""


def _words(text: str) -> str:
    return rf"regexp_extract_all({_lowered(f'coalesce({text}, {chr(39) * 2})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


WU_MANBER = f"""
WITH docs AS (SELECT doc_id, {_words('text')} AS words FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, words, least(10, len(words)) AS m FROM (SELECT item_id, {_words('text')} AS words FROM benchmark)),
windows AS (
  SELECT DISTINCT item, m, array_to_string(words[k:k + m - 1], ' ') AS passage
  FROM (SELECT *, unnest(range(1, len(words) - m + 2)) AS k FROM items WHERE m > 0)),
places AS (
  SELECT doc_id, k, m, array_to_string(words[k:k + m - 1], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM docs), (SELECT DISTINCT m FROM windows) WHERE k + m - 1 <= len(words)),
found AS (SELECT DISTINCT doc_id, k, m, item FROM places JOIN windows USING (m, passage)),
hits AS (SELECT doc_id, COUNT(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

_FAILURES = {
    "A": "len(words) < 50",
    "B": "100 * len(list_distinct(words)) < 65 * len(words)",
    "C": "100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body)",
    "D": "regexp_matches(body, '[#$%&*|]')",
    "E": "coalesce(doc_id > MIN(doc_id) OVER (PARTITION BY body), false)",
}
_FILTER_NAMES = ", ".join(f"({k}, '{letter}')" for k, letter in enumerate("ABCDE"))

FILTER_AUDIT = rf"""
WITH RECURSIVE filters(f, letter) AS (VALUES {_FILTER_NAMES}),
words AS (
  SELECT *, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
masks AS (
  SELECT doc_id, coalesce(source, '') AS part, {" + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, fails in enumerate(_FAILURES.values()))} AS mask
  FROM words),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, mask, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN told USING (doc_id) GROUP BY part, mask),
orders(filter_order, step, f, before, after) AS (
  SELECT letter, 1, f, 0, 1 << f FROM filters
  UNION ALL SELECT filter_order || letter, step + 1, filters.f, after, after | (1 << filters.f) FROM orders, filters WHERE after & (1 << filters.f) = 0),
steps AS (
  SELECT whole.filter_order, one.step, one.f, one.before
  FROM orders whole JOIN orders one ON starts_with(whole.filter_order, one.filter_order) WHERE whole.step = 5),
counted AS (
  SELECT part, filter_order, step, f,
    SUM(n) FILTER (mask & before = 0 AND mask & (1 << f) = 0) AS kept, SUM(n) FILTER (mask & before = 0 AND mask & (1 << f) <> 0) AS removed,
    SUM(n) FILTER (mask & before <> 0 AND mask & (1 << f) <> 0) AS redundant, SUM(n) FILTER (mask = 1 << f) AS unique_fails,
    SUM(good) FILTER (mask & before = 0 AND mask & (1 << f) <> 0) AS good_lost, SUM(toxic) FILTER (mask & before = 0 AND mask & (1 << f) <> 0) AS toxic_lost
  FROM judged, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(SUM(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted"""

HARD_NEGATIVES = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v, row_number() OVER () AS row
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM valid a JOIN valid r ON a.row <> r.row WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS place
  FROM scored WHERE same QUALIFY place <= 5),
near AS (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, place ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM near WHERE rank <= 10"""

ORACLE_SQL = {
    "op2_ngram_jaccard_join": NGRAM_JACCARD,
    "op3_url_redirects": URL_REDIRECTS,
    "op4_warc_dictionary": WARC_DICTIONARY,
    "op6_chat_parts": CHAT_PARTS,
    "op8_wu_manber": WU_MANBER,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_hard_negatives": HARD_NEGATIVES,
}
