"""SQL of the queries that SQL can express."""

from __future__ import annotations

from ledgerfold.llm import licenses

SPLIT = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

SQL = {}

SQL["op2_decontamination"] = f"""
WITH iw AS (SELECT item_id, {SPLIT} AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, {SPLIT} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM g),
p AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
h AS (SELECT r, i, p.k, item_id FROM p JOIN g ON p.win = g.win AND p.k = g.k),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

_RULES = ("example.com/de/", "example.net/en/", "net/", "org/fr/")


def _fits(rule: str) -> str:
    name, _, tail = rule.partition("/")
    return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}'))"


SQL["op6_url_filters"] = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT DISTINCT regexp_replace(host || path, '/+$', '') AS key FROM p
      WHERE list_has_any(string_split(host, '.'), ['casino-win', 'free-bets', 'cheap-pills', 'ads-track'])),
f AS (SELECT *, regexp_replace(host || path, '/+$', '') AS key,
             CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for r in sorted(_RULES, key=lambda r: -len(r)))} END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM f"""

SQL["op1_top_k_search"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _license_sql() -> str:
    """The catalogue as a table of values; rules as replacements in the joined sequence."""
    known = ", ".join(f"('{text}', '{name}')" for text, name in licenses.KNOWN.items())
    steps, seq = [], "seq0"
    for i, (_, rule) in enumerate(licenses.RULES):
        steps.append(f"s{i} AS (SELECT *, contains({seq}, ';{';;'.join(rule)};') AS m{i}, replace({seq}, ';{';;'.join(rule)};', ';;') AS seq{i + 1} FROM {'j' if i == 0 else f's{i - 1}'})")
        seq = f"seq{i + 1}"
    hits = ", ".join(f"CASE WHEN m{i} THEN '{licence}' END" for i, (licence, _) in enumerate(licenses.RULES))
    return f"""
WITH k(norm, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, unnest(string_split_regex(text, '[\\r\\n]+')) AS line, unnest(range(len(string_split_regex(text, '[\\r\\n]+')))) AS ln FROM d),
p AS (SELECT r, ln, unnest(string_split_regex(regexp_replace(line, '([.!?])[ \\t]+', '\\1\n', 'g'), '\n')) AS s,
             unnest(range(len(string_split_regex(regexp_replace(line, '([.!?])[ \\t]+', '\\1\n', 'g'), '\n')))) AS sn FROM l),
n AS (SELECT r, ln, sn, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS norm FROM p),
f AS (SELECT r, list(name ORDER BY ln, sn) AS ids FROM n JOIN k USING (norm) GROUP BY r),
j AS (SELECT d.r, doc_id, coalesce(ids, []) AS ids, ';' || array_to_string(coalesce(ids, []), ';;') || ';' AS seq0 FROM d LEFT JOIN f ON d.r = f.r),
{", ".join(steps)}
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM s{len(licenses.RULES) - 1}"""


SQL["op4_license_scan"] = _license_sql()
