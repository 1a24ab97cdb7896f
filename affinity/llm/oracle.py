"""DuckDB SQL for the queries that SQL can express (same tables, same columns)."""

from __future__ import annotations

from affinity.llm.licenses import GRAM, NOTICES, PHRASES, SHARE

ORACLE: dict[str, str] = {}

_MD5_UNIT = "(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0)"

ORACLE["op3_poisson_mix"] = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM n) * 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM n) / n AS rate FROM n),
parts AS (SELECT source, greatest(ceil(rate / 16.0), 1)::INT AS parts, rate FROM rates),
terms AS (SELECT source, parts, rate / parts AS mean, 0 AS i, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS c FROM parts
  UNION ALL SELECT source, parts, mean, i + 1, p * mean / (i + 1), c + p * mean / (i + 1) FROM terms WHERE i < 95),
tables AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY i) AS cs FROM terms GROUP BY source),
drawn AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cs, lambda c: c <=
    {_MD5_UNIT.format(text="'mix|' || d.doc_id || '|' || i")}))))::BIGINT AS times
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT * EXCLUDE (times), unnest(range(0, times)) AS copy_no FROM drawn WHERE times > 0)
SELECT *, {_MD5_UNIT.format(text="'mix/place|' || doc_id || '|' || copy_no")} AS place FROM copies
"""

_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

# The tables hold no canonical links or refresh redirects, so every page without a rule is a class of its own: allowed.
ORACLE["op4_url_rules"] = f"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

ORACLE["op7_winnowing"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
    lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2),
    lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM dw, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op10_maxscore"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE["op5_recompression"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i,
    unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS g FROM d WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rn FROM g),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE rn > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op11_itemset_counting"] = rf"""
WITH p AS (SELECT coalesce(lang::VARCHAR, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) z(s) WHERE len(w) >= s),
f AS (SELECT lang, phrase, s, count(*) AS a FROM g GROUP BY lang, phrase, s HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE s > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(v[1:k], ' ') AS lp, array_to_string(v[k + 1:s], ' ') AS rp
  FROM (SELECT *, unnest(range(1, s)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * cuts.a) // (x.a + y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, unnest(list_transform(range(1, s - m + 2), lambda i: array_to_string(v[i:i + m - 1], ' '))) AS phrase
  FROM (SELECT *, unnest(range(2, s)) AS m FROM c)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.base}, '{t.text}')" for i, t in enumerate(PHRASES + NOTICES))
_LICENSE_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op12_diagonal_voting"] = rf"""
WITH t AS (SELECT i, label, base, {_LICENSE_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(i, label, base, text)),
tt AS (SELECT *, least(len(w), {GRAM}) AS k, greatest(len(w) - {GRAM}, 0) + 1 AS n_grams, CASE WHEN base THEN 0 ELSE len(w) // 8 END AS slack FROM t),
tg AS (SELECT i, k, "at", array_to_string(w["at" + 1:"at" + k], ' ') AS g FROM (SELECT *, unnest(range(0, n_grams)) AS "at" FROM tt)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_LICENSE_WORDS} AS w FROM documents),
dg AS (SELECT row, k, unnest(range(0, len(w) - k + 1)) AS p,
    unnest(list_transform(range(0, len(w) - k + 1), lambda p: array_to_string(w[p + 1:p + k], ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM tt) sizes WHERE len(w) >= k),
hits AS (SELECT row, i, p, "at", p - "at" AS diagonal FROM dg JOIN tg USING (k, g)),
steps AS (SELECT row, i, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY row, i ORDER BY diagonal) > slack, true) AS fresh
  FROM (SELECT DISTINCT row, i, diagonal FROM hits) JOIN tt USING (i)),
regions AS (SELECT row, i, diagonal, sum(fresh::INT) OVER (PARTITION BY row, i ORDER BY diagonal) AS region FROM steps),
spans AS (SELECT row, i, count(DISTINCT "at") AS cover, min(p) AS first FROM hits JOIN regions USING (row, i, diagonal) GROUP BY row, i, region),
kept AS (SELECT row, label, base, first, cover::DOUBLE / n_grams AS share FROM spans JOIN tt USING (i) WHERE cover::DOUBLE / n_grams >= {SHARE}),
found AS (SELECT row, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    0.5::DOUBLE + 0.5::DOUBLE * coalesce(max(share) FILTER (NOT base), 0) AS score FROM kept GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN found USING (row)
"""
