"""The queries that SQL can express, in DuckDB's SQL over the whole tables."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, generate_subscripts(xs, 1) AS pos, unnest(xs) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), {_AZ}) AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS xs FROM documents),
s AS (SELECT doc_id, xs, unnest(range(1, len(xs) - 18)) AS i FROM w WHERE len(xs) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(xs[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE n > 1),
x AS (SELECT doc_id, generate_subscripts(xs, 1) AS p, unnest(xs) AS word FROM w),
k AS (SELECT x.doc_id, count(*) AS n_words, count(c.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL), '') AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""

def _suffix_dedup() -> str:
    """A row a byte; a window's hash is put together from those of 2, 4, .. 64 bytes, and of 64 + 32 + 4."""
    w = "WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
    steps = ["b AS (SELECT doc_id, generate_subscripts(bs, 1) AS i, unnest(bs) AS h1 FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents))"]
    last = "b"
    for k in (1, 2, 4, 8, 16, 32):
        steps.append(f"h{2 * k} AS (SELECT *, hash(h{k}, lead(h{k}, {k}) OVER w) AS h{2 * k} FROM {last} {w})")
        last = f"h{2 * k}"
    steps.append(f"f AS (SELECT doc_id, i, h1 AS x, hash(h64, lead(h32, 64) OVER w, lead(h4, 96) OVER w) AS k, lead(i, 99) OVER w IS NOT NULL AS whole FROM {last} {w})")
    steps.append("r AS (SELECT doc_id, i, x, whole AND row_number() OVER (PARTITION BY k, whole ORDER BY doc_id, i) > 1 AS again FROM f)")
    steps.append(f"c AS (SELECT doc_id, i, x, coalesce(max(CASE WHEN again THEN i END) OVER w > i - 100, false) AS gone FROM r {w})")
    steps.append(f"g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER w, false) AS first FROM c {w})")
    steps.append("s AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN s USING (doc_id)"


SUFFIX_DEDUP = _suffix_dedup()


def _escaped(x: str, line: bool = False) -> str:
    out = f"replace(replace(replace({x}, '\\', '\\\\'), '<', '\\l'), '[', '\\b')"
    return f"replace({out}, chr(10), '\\n')" if line else out


CHAT_FORMATTING = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<s>[INST]') + length({_escaped("role", True)}) + 1 + length({_escaped("text")}) + length('[/INST]</s>'))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

URL_FILTERS = rf"""WITH u AS (SELECT page_id, contains(coalesce(url, ''), '://') AS has, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN NOT has THEN NULL
 WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS xs FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS xs FROM benchmark),
m AS (SELECT item_id, xs, least(13, len(xs)) AS m FROM b WHERE len(xs) > 0),
t AS (SELECT DISTINCT item_id, m, array_to_string(xs[i:i + m - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(xs) - m + 2)) AS i FROM m)),
s AS (SELECT doc_id, xs, m, unnest(range(1, len(xs) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM m) WHERE len(xs) >= m),
h AS (SELECT doc_id, i, s.m, item_id FROM s JOIN t ON s.m = t.m AND array_to_string(xs[i:i + s.m - 1], ' ') = t.w),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, len(xs) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(xs) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
