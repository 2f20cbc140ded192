"""DuckDB SQL of the queries that SQL can express."""

from . import licenses

LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT s.doc_id, s.line, s.pos, c.k IS NOT NULL AND s.doc_id <> c.keeper AS gone FROM keyed s LEFT JOIN common c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_FOUND = r"""
  SELECT doc_id, source, lang, {rank} AS rank,
         unnest(list_transform(range(1, len(m) + 1), lambda i: {{'i': i,
           's': list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0),
           'n': length(m[i]), 'v': v[i]}})) AS hit
  FROM (SELECT doc_id, source, lang, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {group}) AS v,
               regexp_split_to_array(text, {pattern}) AS p FROM documents WHERE regexp_matches(text, {pattern}))
"""
_ASSIGN = r"""'(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""

SECRETS = r"""
WITH hits AS (
""" + " UNION ALL ".join(
    _FOUND.format(rank=rank, pattern=pattern, group=group) for rank, (pattern, group) in enumerate(
        ((_ASSIGN, 2), ("'AKIA[A-Z0-9]+'", 0), ("'[0-9a-f]+'", 0), ("'[A-Za-z0-9+_=-]{24,}'", 0)))) + r"""),
spans AS (
  SELECT doc_id, source, lang, rank, CAST(hit.s AS BIGINT) AS s, CAST(hit.s + hit.n AS BIGINT) AS e, hit.v AS v FROM hits
  WHERE (rank = 0 AND length(hit.v) >= 12) OR (rank = 1 AND length(hit.v) >= 18) OR (rank = 2 AND length(hit.v) >= 16)
     OR (rank = 3 AND regexp_matches(hit.v, '[a-z]') AND regexp_matches(hit.v, '[A-Z]') AND regexp_matches(hit.v, '[0-9]'))),
outer_spans AS (
  SELECT * FROM spans a WHERE rank < 3 OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.rank < 3 AND b.doc_id = a.doc_id AND b.s <= a.s AND a.e <= b.e)),
owned AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repositories FROM outer_spans GROUP BY v),
told AS (
  SELECT o.*, owners < 3 AND repositories < 12 AS live, (['assign', 'access', 'hex', 'owned'])[rank + 1] || ':' || s || ':' || e AS name
  FROM outer_spans o JOIN owned USING (v) WHERE rank < 3 OR (owners < 3 AND repositories < 12))
SELECT d.doc_id, count(name) FILTER (WHERE rank = 0) AS n_assign, count(name) FILTER (WHERE rank = 1) AS n_access,
       count(name) FILTER (WHERE rank = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY s, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY s, rank), '') AS spans,
       count(name) FILTER (WHERE live) AS n_live, count(name) FILTER (WHERE NOT live) AS n_example
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id GROUP BY d.doc_id
"""

URL_FILTERS = r"""
WITH parts AS (
  SELECT page_id, url, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS path,
         CAST(date '2024-01-01' + CAST(page_id * 7919 % 366 AS INT) AS DATE) AS fetched,
         CAST(date '2024-01-01' + CAST(page_id * 104729 % 366 AS INT) AS DATE) AS day
  FROM pages),
changes AS (
  SELECT 'list' || (page_id % 4) AS list, CASE page_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'path' ELSE 'domain' END AS kind,
         CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN host || '/' || coalesce(path[1], '')
              ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS value,
         day, bool_or(page_id % 5 < 2) AS blocked
  FROM parts GROUP BY ALL),
keys AS (
  SELECT page_id, url, fetched, 'host' AS kind, host AS value FROM parts
  UNION ALL
  SELECT page_id, url, fetched, 'domain', unnest(list_transform(range(1, len(string_split(host, '.'))),
         lambda i: array_to_string(string_split(host, '.')[i:], '.'))) FROM parts
  UNION ALL
  SELECT page_id, url, fetched, 'path', unnest(list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[:i], '/'))) FROM parts),
latest AS (
  SELECT page_id, kind, value, list, arg_max(blocked, day) AS blocked
  FROM keys JOIN changes USING (kind, value) WHERE day <= fetched GROUP BY ALL),
found AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists FROM latest WHERE blocked GROUP BY page_id)
SELECT page_id, url, fetched, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists, coalesce(n, 0) > 0 AS blocked
FROM parts LEFT JOIN found USING (page_id)
"""

_WORDS = "regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _rows(pairs) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in pairs)


#: Every block of every document against every template of its scale.
LICENSES = f"""
WITH templates AS (
  SELECT row_number() OVER () AS t, label, {_WORDS.format(text="text")} AS w FROM (VALUES {_rows(licenses.TEMPLATES)}) v(label, text)),
sized AS (
  SELECT t, label, list_distinct(w) AS w, CAST(greatest(4, pow(2, ceil(log2(len(w))))) AS BIGINT) AS scale FROM templates),
phrases AS (SELECT {_WORDS.format(text="phrase")} AS w, label FROM (VALUES {_rows(licenses.PHRASES)}) v(phrase, label)),
docs AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
places AS (
  SELECT doc_id, label, pos FROM (
    SELECT d.doc_id, p.label, d.w AS dw, p.w AS pw, unnest(range(0, len(d.w))) AS pos FROM docs d, phrases p WHERE list_has_all(d.w, p.w))
  WHERE dw[pos + 1 : pos + len(pw)] = pw),
blocks AS (
  SELECT doc_id, scale, list_distinct(w[k * scale + 1 : k * scale + 2 * scale]) AS b FROM (
    SELECT doc_id, w, scale, unnest(range(0, (len(w) + scale - 1) // scale)) AS k FROM docs, (SELECT DISTINCT scale FROM sized))),
met AS (
  SELECT doc_id, label, n / len(w) AS score FROM (
    SELECT doc_id, label, w, len(list_intersect(b, w)) AS n FROM blocks JOIN sized USING (scale))
  WHERE n >= ceil(len(w) * {licenses.THRESHOLD} - 1e-9)),
p AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list_distinct(list(label)) AS labels FROM places GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, max(score) AS score, list_distinct(list(label)) AS labels FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n, 0) AS n_base, p.a AS first_word, p.z AS last_word,
       coalesce(array_to_string(list_sort(p.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN p.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.score, 0) END AS score, coalesce(m.n, 0) AS n_blocks
FROM docs d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_TERMS = _WORDS.replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")

#: Every document's score for every item.
LEXICAL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS.format(text="text")}) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, docs),
norms AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM sizes, total),
items AS (SELECT item_id, unnest(list_distinct({_TERMS.format(text="text")})) AS t FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items JOIN weights USING (t) JOIN tf USING (t) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

#: Every anchor against every row.
NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
"""
