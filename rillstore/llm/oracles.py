"""SQL for an oracle: the contracts of operators that SQL can express, written independently of the operators."""

from __future__ import annotations

from rillstore.llm.decontam import Overlap

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), c AS (SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)
), word AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), kept AS (
  SELECT word.doc_id AS doc_id, string_agg(x, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id
)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_P = Overlap()
# Every accepted passage of w tokens with at most s substituted holds a run of (w - s) / (s + 1) equal tokens,
# rounded up: the SQL starts from such runs, and so depends on no mask.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents
), b0 AS (SELECT item_id, {_TOKENS} AS w FROM benchmark
), b1 AS (SELECT item_id, w, least(len(w), {_P.overlap}) AS n, CAST(ceil(least(len(w), {_P.overlap}) * {_P.percent} / 100) AS BIGINT) AS e FROM b0 WHERE len(w) > 0
), b AS (SELECT item_id, w, greatest(1, CAST(ceil(e / (n - e + 1)) AS BIGINT)) AS run FROM b1
), runs AS (SELECT DISTINCT run FROM b
), ds AS (
  SELECT doc_id, i, run, array_to_string(w[i:i + run - 1], ' ') AS k FROM (SELECT doc_id, w, run, unnest(range(1, len(w) - run + 2)) AS i FROM d JOIN runs ON len(w) >= run)
), bs AS (
  SELECT item_id, i, run, array_to_string(w[i:i + run - 1], ' ') AS k FROM (SELECT item_id, w, run, unnest(range(1, len(w) - run + 2)) AS i FROM b)
), hit AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs ON ds.k = bs.k AND ds.run = bs.run
), lined AS (
  SELECT hit.doc_id AS doc_id, hit.item_id AS item_id, least({_P.overlap}, len(b.w)) AS n,
    list_transform(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1), lambda p: CASE WHEN b.w[p] = d.w[p + shift] THEN 1 ELSE 0 END) AS same
  FROM hit JOIN d ON d.doc_id = hit.doc_id JOIN b ON b.item_id = hit.item_id
), sure AS (
  SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, n, same, unnest(range(1, len(same) - n + 2)) AS i FROM lined WHERE len(same) >= n) WHERE list_sum(same[i:i + n - 1]) * 100 >= n * {_P.percent}
), c AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items FROM sure GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, items IS NOT NULL AS contaminated, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, coalesce(items, []) AS item_ids, items IS NULL AS kept
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""

# In the driver's pages the article is one element of headings and paragraphs.
PAGES = r"""
WITH a AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts FROM pages
), b AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a
), c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
