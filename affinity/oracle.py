"""DuckDB oracle SQL for every registered query.

The oracles are written independently of the Spark code, in plain SQL
over the driver's tables: row_number() windows where Spark uses max_by,
cross joins with a WHERE predicate where Spark uses the pair join, and
per-pair cosine sums where Spark collapses vectors. Lambdas are DuckDB's
``lambda x: ...`` form.
"""

from __future__ import annotations

from affinity.sources.fixtures import CONSTRAINT_CYCLE, CONSTRAINT_SETS, REQUEST_CASES


def _sql_str(v):
    return "NULL::VARCHAR" if v is None else "'" + str(v).replace("'", "''") + "'"


def _sql_list(v, typ):
    if v is None:
        return f"NULL::{typ}[]"
    if typ == "VARCHAR":
        return "[" + ", ".join(_sql_str(x) for x in v) + f"]::VARCHAR[]"
    return "[" + ", ".join(str(int(x)) for x in v) + f"]::{typ}[]"


def _request_values() -> str:
    rows = []
    for (rid, user, num, typ, search, rtype, ckey, brand, cats, wkeys, wextra, bkeys) in REQUEST_CASES:
        rows.append("(" + ", ".join([
            _sql_str(rid), _sql_str(user), f"{int(num)}::INTEGER", _sql_str(typ), _sql_str(search),
            _sql_str(rtype), "NULL::BIGINT" if ckey is None else f"{int(ckey)}::BIGINT", _sql_str(brand),
            _sql_list(cats, "VARCHAR"), _sql_list(wkeys, "BIGINT"), _sql_list(wextra, "VARCHAR"),
            _sql_list(bkeys, "BIGINT")]) + ")")
    return ",\n    ".join(rows)


def _constraint_values() -> str:
    return ", ".join(f"({eid}::BIGINT, TIMESTAMP '{ts}', {k}::BIGINT)"
                     for eid, ts, keys in CONSTRAINT_SETS for k in keys)


# ---- common CTEs: the fixture adapter and the engine's derived tables ------
BASE_CTES = r"""
users AS (
  SELECT concat('u', c_custkey) AS user_id FROM customer
), part_names AS (
  SELECT p_partkey, concat(p_name, ' ', p_partkey) AS item_id FROM part
), cosmetics AS (
  SELECT n.item_id, 'cosmetic' AS item_type,
         CASE WHEN p.p_partkey % 13 = 0 THEN NULL
              ELSE [p.p_type, CASE WHEN p.p_size >= 25 THEN 'large size' ELSE 'small size' END] END AS categories,
         CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE p.p_brand END AS brand,
         CAST(NULL AS VARCHAR[]) AS cosmetics, CAST(NULL AS VARCHAR) AS upload_date
  FROM part p JOIN part_names n USING (p_partkey)
), contents AS (
  SELECT concat('content ', o.o_orderkey) AS item_id, 'content' AS item_type,
         CAST(NULL AS VARCHAR[]) AS categories, CAST(NULL AS VARCHAR) AS brand,
         list(DISTINCT n.item_id) FILTER (WHERE n.item_id IS NOT NULL) AS cosmetics,
         strftime(any_value(o.o_orderdate), '%Y-%m-%d') AS upload_date
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
                LEFT JOIN part_names n ON n.p_partkey = l.l_partkey
  GROUP BY o.o_orderkey
), items AS (
  SELECT * FROM contents UNION ALL SELECT * FROM cosmetics
), log AS (
  SELECT e.event_id, concat('u', e.user_id) AS user_id, e.ts,
         CASE e.event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'play' WHEN 'purchase' THEN 'own'
              WHEN 'signup' THEN 'rate' ELSE CASE WHEN e.event_id % 2 = 0 THEN 'scrap' ELSE 'cancel_scrap' END END AS event,
         CASE WHEN e.event_type = 'click' THEN 'content' ELSE 'cosmetic' END AS target_type,
         CASE WHEN e.event_type = 'click' THEN concat('content ', e.props->>'k') ELSE n.item_id END AS item_id,
         CASE WHEN e.event_type = 'signup' THEN 0.5 * (1 + e.event_id % 10) END::DOUBLE AS rating
  FROM events e JOIN part_names n ON n.p_partkey = CAST(e.props->>'k' AS BIGINT)
), tlog AS (
  SELECT CASE WHEN event IN ('cancel_scrap', 'cancle_scrap') THEN 'cancel_scrap' ELSE event END AS event,
         user_id, item_id, ts, event_id, rating
  FROM log
  WHERE (target_type = 'content' AND event IN ('view', 'play', 'scrap', 'cancel_scrap', 'cancle_scrap'))
     OR (target_type = 'cosmetic' AND event IN ('view', 'own', 'rate', 'scrap', 'cancel_scrap', 'cancle_scrap'))
), vlog AS (
  SELECT * FROM tlog
  WHERE user_id IN (SELECT user_id FROM users) AND item_id IN (SELECT item_id FROM items)
), a_view AS (
  SELECT user_id, item_id, sum(1.0::DOUBLE) AS rating FROM vlog WHERE event = 'view' GROUP BY user_id, item_id
), a_play AS (
  SELECT user_id, item_id, sum(5.0::DOUBLE) AS rating FROM vlog WHERE event = 'play' GROUP BY user_id, item_id
), a_own AS (
  SELECT user_id, item_id, sum(3.0::DOUBLE) AS rating FROM vlog WHERE event = 'own' GROUP BY user_id, item_id
), a_rate AS (
  SELECT user_id, item_id, rating - 2.75::DOUBLE AS rating FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM vlog WHERE event = 'rate') WHERE rn = 1
), a_scrap AS (
  SELECT user_id, item_id, CASE WHEN event = 'scrap' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS rating FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM vlog WHERE event IN ('scrap', 'cancel_scrap')) WHERE rn = 1
), a_rate_own AS (
  SELECT coalesce(o.user_id, r.user_id) AS user_id, coalesce(o.item_id, r.item_id) AS item_id,
         CASE WHEN o.rating IS NOT NULL AND r.rating IS NOT NULL THEN o.rating * r.rating
              ELSE coalesce(o.rating, r.rating) END AS rating
  FROM a_own o FULL OUTER JOIN a_rate r ON o.user_id = r.user_id AND o.item_id = r.item_id
), a_total AS (
  SELECT user_id, item_id, sum(rating) AS rating FROM (
    SELECT * FROM a_rate_own UNION ALL SELECT * FROM a_view UNION ALL SELECT * FROM a_scrap
    UNION ALL SELECT * FROM a_play) GROUP BY user_id, item_id
), pop_parts AS (
  SELECT item_id, sum(ro) AS pop_rate_own, sum(v) AS pop_view, sum(p) AS pop_play, sum(s) AS pop_scrap FROM (
    SELECT item_id, rating AS ro, NULL::DOUBLE AS v, NULL::DOUBLE AS p, NULL::DOUBLE AS s FROM a_rate_own
    UNION ALL SELECT item_id, NULL, 1.0::DOUBLE, NULL, NULL FROM vlog WHERE event = 'view'
    UNION ALL SELECT item_id, NULL, NULL, 1.0::DOUBLE, NULL FROM vlog WHERE event = 'play'
    UNION ALL SELECT item_id, NULL, NULL, NULL, CASE WHEN event = 'scrap' THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END
      FROM vlog WHERE event IN ('scrap', 'cancel_scrap')) GROUP BY item_id
), popularity AS (
  SELECT item_id, coalesce(pop_rate_own, 0) + coalesce(pop_view, 0) + coalesce(pop_play, 0)
                  + coalesce(pop_scrap, 0) AS popularity FROM pop_parts
), owned AS (
  SELECT DISTINCT user_id, item_id AS cosmetic_id FROM vlog WHERE event = 'own'
), mentions AS (
  SELECT DISTINCT c.item_id AS content_id, m.cosmetic_id
  FROM (SELECT item_id, unnest(cosmetics) AS cosmetic_id FROM items
        WHERE item_type = 'content' AND len(cosmetics) > 0) m
  JOIN items c ON c.item_id = m.item_id
  WHERE m.cosmetic_id IN (SELECT item_id FROM items)
), overlap AS (
  SELECT o.user_id, m.content_id, count(*) * 5.0::DOUBLE AS score
  FROM owned o JOIN mentions m ON o.cosmetic_id = m.cosmetic_id GROUP BY o.user_id, m.content_id
), plog AS (
  SELECT event_id, ts, concat('u', user_id) AS entity_id, event_type, CAST(props->>'k' AS VARCHAR) AS k,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN '$set' WHEN event_type = 'error' THEN '$unset'
              WHEN event_type = 'signup' AND event_id % 20 = 1 THEN '$delete' END AS op
  FROM events
), pkv AS (
  SELECT entity_id, event_id, ts, op, 'a' AS key, k AS value FROM plog WHERE event_type IN ('view', 'purchase')
  UNION ALL SELECT entity_id, event_id, ts, op, 'b', k FROM plog WHERE event_type IN ('click', 'purchase')
  UNION ALL SELECT entity_id, event_id, ts, op, 'a', NULL FROM plog WHERE event_type = 'error'
), p_del AS (
  SELECT entity_id, ts AS d_ts, event_id AS d_id FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM plog WHERE op = '$delete') WHERE rn = 1
), p_alive AS (
  SELECT DISTINCT s.entity_id FROM plog s LEFT JOIN p_del d ON s.entity_id = d.entity_id
  WHERE s.op = '$set' AND (d.d_ts IS NULL OR s.ts > d.d_ts OR (s.ts = d.d_ts AND s.event_id > d.d_id))
), p_last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, key ORDER BY ts DESC, event_id DESC) AS rn FROM pkv
  ) WHERE rn = 1
), p_kept AS (
  SELECT l.entity_id, l.key, l.value FROM p_last l LEFT JOIN p_del d ON l.entity_id = d.entity_id
  WHERE l.op = '$set' AND (d.d_ts IS NULL OR l.ts > d.d_ts OR (l.ts = d.d_ts AND l.event_id > d.d_id))
), folded_users AS (
  SELECT a.entity_id, max(CASE WHEN k.key = 'a' THEN k.value END) AS prop_a,
         max(CASE WHEN k.key = 'b' THEN k.value END) AS prop_b
  FROM p_alive a LEFT JOIN p_kept k ON a.entity_id = k.entity_id GROUP BY a.entity_id
), constraint_rule(event_id, ts, rest) AS (
  VALUES __CONSTRAINTS__
), constraint_spec AS (
  SELECT event_id, ts, p_partkey FROM constraint_rule JOIN part ON p_partkey % __CYCLE__ = rest
), constraint_sets AS (
  SELECT s.event_id, s.ts, list(n.item_id) AS items
  FROM constraint_spec s JOIN part_names n USING (p_partkey) GROUP BY s.event_id, s.ts
), unavailable AS (
  SELECT DISTINCT unnest(items) AS item_id FROM (
    SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM constraint_sets) WHERE rn = 1
), seen AS (
  SELECT DISTINCT user_id, item_id FROM log
  WHERE event IN ('own', 'scrap') AND target_type IN ('content', 'cosmetic', 'item')
), recent AS (
  SELECT DISTINCT user_id, item_id FROM (
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM log WHERE event IN ('view', 'play', 'own', 'rate', 'scrap')
      AND target_type IN ('content', 'cosmetic', 'item')) WHERE rn <= 10
), vecs AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings
), vec_keys AS (
  SELECT 'i' AS kind, n.item_id AS id, p_partkey AS k FROM part_names n WHERE p_partkey % 5 <> 0
  UNION ALL SELECT 'i', concat('content ', o_orderkey), o_orderkey FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT 'u', concat('u', c_custkey), c_custkey FROM customer WHERE c_custkey % 3 <> 0
), given AS (
  SELECT kind, id, CASE WHEN (k // (n * len(f))) % 2 = 1 THEN list_transform(t, lambda x: -x) ELSE t END AS f FROM (
    SELECT kind, id, k, n, f, list_concat(f[(k // n) % len(f) + 1:], f[:(k // n) % len(f)]) AS t
    FROM vec_keys, (SELECT count(*) AS n FROM embeddings), vecs WHERE vec_id = k % n)
), item_vecs AS (
  SELECT id AS item_id, f FROM given WHERE kind = 'i'
), user_vecs AS (
  SELECT id AS user_id, f FROM given WHERE kind = 'u'
), item_model AS (
  SELECT i.*, v.f, coalesce(p.popularity, 0.0::DOUBLE) AS popularity
  FROM items i LEFT JOIN item_vecs v ON i.item_id = v.item_id LEFT JOIN popularity p ON i.item_id = p.item_id
), req_spec(request_id, user_id, num, item_type, search, result_type, cosmetic_key, brand, categories,
            white_keys, white_extra, black_keys) AS (
  VALUES __REQUESTS__
), customer_part AS (
  SELECT c_custkey, c_custkey % 6 AS kind, p_name, p_brand, p_type, part.p_partkey,
         concat(p_name, ' ', part.p_partkey) AS own, nx.item_id AS nxt
  FROM customer JOIN part ON part.p_partkey = c_custkey % (SELECT count(*) FROM part)
  LEFT JOIN part_names nx ON nx.p_partkey = part.p_partkey + 1
), requests AS (
  SELECT concat('c', c_custkey) AS request_id, concat('u', c_custkey) AS user_id, 5::INTEGER AS num,
         CASE WHEN kind IN (1, 4) THEN 'content' ELSE 'cosmetic' END AS item_type,
         CASE WHEN kind IN (0, 1) THEN concat(string_split(p_name, ' ')[-1], p_partkey) END AS search, NULL::VARCHAR AS result_type,
         CASE WHEN kind = 4 THEN own END AS cosmetic, CASE WHEN kind = 2 THEN p_brand END AS brand,
         CASE WHEN kind = 3 THEN [p_type] END AS categories,
         CASE WHEN kind = 5 THEN list_filter([own, nxt], lambda x: x IS NOT NULL) END AS white_list, NULL::VARCHAR[] AS black_list,
         CASE WHEN kind IN (0, 1) THEN [concat(string_split(p_name, ' ')[-1], p_partkey)] END AS terms
  FROM customer_part
  UNION ALL
  SELECT s.request_id, s.user_id, s.num, s.item_type, s.search, s.result_type,
         (SELECT n.item_id FROM part_names n WHERE n.p_partkey = s.cosmetic_key) AS cosmetic,
         s.brand, s.categories,
         CASE WHEN s.white_keys IS NULL THEN NULL ELSE list_distinct(list_concat(
           coalesce((SELECT list(n.item_id) FROM part_names n WHERE list_contains(s.white_keys, n.p_partkey)), []::VARCHAR[]),
           coalesce(s.white_extra, []::VARCHAR[]))) END AS white_list,
         CASE WHEN s.black_keys IS NULL THEN NULL ELSE
           coalesce((SELECT list(n.item_id) FROM part_names n WHERE list_contains(s.black_keys, n.p_partkey)), []::VARCHAR[])
         END AS black_list,
         CASE WHEN s.search IS NULL THEN NULL
              WHEN regexp_matches(s.search, '^ +$') THEN []::VARCHAR[]
              ELSE list_distinct(string_split(regexp_replace(s.search, ' +$', ''), ' ')) END AS terms
  FROM req_spec s
), full_black AS (
  SELECT request_id, unnest(black_list) AS item_id FROM requests WHERE black_list IS NOT NULL
  UNION SELECT r.request_id, s.item_id FROM requests r JOIN seen s ON r.user_id = s.user_id
  UNION SELECT r.request_id, u.item_id FROM requests r, unavailable u
), own_black AS (
  SELECT DISTINCT request_id, unnest(black_list) AS item_id FROM requests WHERE black_list IS NOT NULL
), common_pred AS (
  SELECT r.request_id, i.item_id FROM requests r JOIN items i ON i.item_type = r.item_type
  WHERE (r.brand IS NULL OR coalesce(r.brand = i.brand, false))
    AND (r.white_list IS NULL OR list_contains(r.white_list, i.item_id))
    AND (r.black_list IS NULL OR NOT list_contains(r.black_list, i.item_id))
    AND (r.categories IS NULL OR coalesce(list_has_any(r.categories, i.categories), false))
), factor_cand AS (
  SELECT c.request_id, c.item_id FROM common_pred c
  JOIN requests r ON r.request_id = c.request_id JOIN items i ON i.item_id = c.item_id
  WHERE CASE
    WHEN i.item_type = 'cosmetic' THEN
      NOT list_contains(coalesce(r.terms, []::VARCHAR[]), '')
      AND len(list_filter(coalesce(r.terms, []::VARCHAR[]), lambda t: NOT contains(replace(i.item_id, ' ', ''), t))) = 0
    WHEN i.item_type = 'content' THEN
      CASE WHEN r.cosmetic IS NOT NULL THEN coalesce(list_contains(i.cosmetics, r.cosmetic), false)
           ELSE len(list_filter(coalesce(i.cosmetics, []::VARCHAR[]), lambda c:
                  len(list_filter(coalesce(r.terms, []::VARCHAR[]),
                      lambda t: NOT coalesce(contains(replace(c, ' ', ''), t), false))) = 0)) > 0 END
    ELSE true END
), overlap_cand AS (
  SELECT c.request_id, c.item_id FROM common_pred c
  JOIN requests r ON r.request_id = c.request_id JOIN items i ON i.item_id = c.item_id
  WHERE CASE
    WHEN i.item_type = 'cosmetic' THEN
      r.terms IS NULL OR (NOT list_contains(r.terms, '')
        AND len(list_filter(r.terms, lambda t: NOT contains(replace(i.item_id, ' ', ''), t))) = 0)
    WHEN i.item_type = 'content' THEN
      CASE WHEN r.cosmetic IS NOT NULL THEN coalesce(list_contains(i.cosmetics, r.cosmetic), false)
           WHEN r.terms IS NULL THEN true
           ELSE len(list_filter(coalesce(i.cosmetics, []::VARCHAR[]), lambda c:
                  len(list_filter(r.terms, lambda t: NOT coalesce(contains(replace(c, ' ', ''), t), false))) = 0)) > 0 END
    ELSE true END
), recent_vec AS (
  SELECT r.user_id, r.item_id, v.f FROM recent r JOIN item_vecs v ON r.item_id = v.item_id
), routes AS (
  SELECT r.request_id,
         CASE WHEN r.result_type IS NOT NULL THEN 'popular'
              WHEN r.user_id IN (SELECT user_id FROM user_vecs) THEN 'known'
              WHEN r.user_id IN (SELECT user_id FROM recent_vec) THEN 'similar'
              ELSE 'popular' END AS route
  FROM requests r
), pop_scored AS (
  SELECT c.request_id, c.item_id, m.popularity AS score FROM factor_cand c JOIN item_model m ON c.item_id = m.item_id
  WHERE NOT EXISTS (SELECT 1 FROM full_black b WHERE b.request_id = c.request_id AND b.item_id = c.item_id)
), known_scored AS (
  SELECT c.request_id, c.item_id, list_dot_product(u.f, m.f) AS score
  FROM factor_cand c JOIN requests r ON r.request_id = c.request_id JOIN user_vecs u ON u.user_id = r.user_id
  JOIN item_model m ON c.item_id = m.item_id
  WHERE m.f IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM full_black b WHERE b.request_id = c.request_id AND b.item_id = c.item_id)
), similar_scored AS (
  SELECT c.request_id, c.item_id,
         sum(CASE WHEN sqrt(list_dot_product(rv.f, rv.f)) * sqrt(list_dot_product(m.f, m.f)) = 0 THEN 0.0::DOUBLE
                  ELSE list_dot_product(rv.f, m.f) / (sqrt(list_dot_product(rv.f, rv.f)) * sqrt(list_dot_product(m.f, m.f)))
             END) AS score
  FROM factor_cand c JOIN requests r ON r.request_id = c.request_id JOIN recent_vec rv ON rv.user_id = r.user_id
  JOIN item_model m ON c.item_id = m.item_id
  WHERE m.f IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM full_black b WHERE b.request_id = c.request_id AND b.item_id = c.item_id)
  GROUP BY c.request_id, c.item_id
), owners AS (
  SELECT DISTINCT user_id FROM owned
), o_route AS (
  SELECT request_id, user_id, CASE
    WHEN item_type = 'content' AND search IS NOT NULL THEN 'zero_plus'
    WHEN item_type = 'content' AND result_type IS NOT NULL THEN 'zero'
    WHEN item_type = 'content' AND cosmetic IS NOT NULL THEN 'zero_plus'
    WHEN item_type = 'content' THEN 'listed'
    WHEN item_type = 'cosmetic' THEN 'zero' END AS oroute
  FROM requests
), o_base AS (
  SELECT o.request_id, i.item_id FROM o_route o JOIN requests r USING (request_id)
  JOIN items i ON i.item_type = r.item_type WHERE o.oroute IN ('zero', 'zero_plus')
  UNION ALL
  SELECT o.request_id, i.item_id FROM o_route o JOIN items i ON i.item_type = 'content' AND len(i.cosmetics) > 0
  WHERE o.oroute = 'listed' AND o.user_id IN (SELECT user_id FROM owners)
), o_scored AS (
  SELECT b.request_id, b.item_id,
         CASE WHEN o.oroute IN ('zero_plus', 'listed') THEN coalesce(ov.score, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS score
  FROM o_base b JOIN o_route o USING (request_id)
  JOIN overlap_cand c ON c.request_id = b.request_id AND c.item_id = b.item_id
  LEFT JOIN overlap ov ON ov.user_id = o.user_id AND ov.content_id = b.item_id
)"""


def _top(scored: str, extra_filter: str = "") -> str:
    return f"""
SELECT request_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT s.request_id, s.item_id, s.score,
         row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.item_id ASC) AS rank, r.num
  FROM ({scored}) s JOIN requests r ON r.request_id = s.request_id {extra_filter}
) WHERE rank <= num"""


_RECOMM = """
  SELECT p.* FROM pop_scored p JOIN routes t USING (request_id) WHERE t.route = 'popular'
  UNION ALL SELECT k.* FROM known_scored k JOIN routes t USING (request_id) WHERE t.route = 'known' AND k.score > 0
  UNION ALL SELECT s.* FROM similar_scored s JOIN routes t USING (request_id) WHERE t.route = 'similar' AND s.score > 0"""

_RECOMM_TOP = f"""
  SELECT request_id, item_id, score FROM (
    SELECT x.*, row_number() OVER (PARTITION BY x.request_id ORDER BY x.score DESC, x.item_id ASC) AS rn, r.num
    FROM ({_RECOMM}) x JOIN requests r USING (request_id)) WHERE rn <= num"""

_COO_TOP = """
  SELECT request_id, item_id, score FROM (
    SELECT x.*, row_number() OVER (PARTITION BY x.request_id ORDER BY x.score DESC, x.item_id ASC) AS rn, r.num
    FROM o_scored x JOIN requests r USING (request_id)) WHERE rn <= num"""


BODIES = {
    "users_view": "SELECT entity_id AS user_id FROM folded_users",
    "items_view": """
SELECT item_id, item_type, array_to_string(list_sort(categories), '|') AS categories_text, brand,
       CAST(len(cosmetics) AS INTEGER) AS n_cosmetics, upload_date FROM items""",
    "events_view_play_own_rate_scrap": """
SELECT CASE WHEN event = 'cancel_scrap' THEN 'scrap' ELSE event END AS kind, user_id, item_id,
       epoch_us(ts) // 1000 AS ts_ms, event_id,
       CASE WHEN event = 'rate' THEN rating END AS rating,
       CASE WHEN event IN ('scrap', 'cancel_scrap') THEN event = 'scrap' END AS scrap
FROM tlog""",
    "property_fold": "SELECT entity_id, prop_a, prop_b FROM folded_users",
    "valid_events": """
SELECT event, user_id, item_id, event_id FROM tlog
WHERE user_id IN (SELECT user_id FROM users) AND item_id IN (SELECT item_id FROM items)
  AND user_id NOT IN (SELECT concat('u', c_custkey) FROM customer WHERE c_custkey % 10 = 9)
  AND item_id NOT IN (SELECT item_id FROM part_names WHERE p_partkey % 25 = 24)""",
    "orphan_events": """
SELECT event_id, event, user_id, item_id, CASE WHEN u AND i THEN 'user,item' WHEN u THEN 'user' ELSE 'item' END AS missing
FROM (SELECT *,
        user_id NOT IN (SELECT concat('u', c_custkey) FROM customer WHERE c_custkey % 10 <> 9) AS u,
        item_id NOT IN (SELECT item_id FROM items)
          OR item_id IN (SELECT item_id FROM part_names WHERE p_partkey % 25 = 24) AS i FROM tlog)
WHERE u OR i""",
    "affinity_view": "SELECT * FROM a_view",
    "affinity_play": "SELECT * FROM a_play",
    "affinity_own": "SELECT * FROM a_own",
    "affinity_rate_latest": "SELECT * FROM a_rate",
    "affinity_scrap_latest": "SELECT * FROM a_scrap",
    "affinity_rate_own": "SELECT * FROM a_rate_own",
    "affinity_total": "SELECT * FROM a_total",
    "popularity_parts": "SELECT * FROM pop_parts",
    "popularity_total": "SELECT * FROM popularity",
    "seen_items": "SELECT * FROM seen",
    "recent_items": "SELECT * FROM recent",
    "unavailable_items": "SELECT * FROM unavailable",
    "blacklist_full": "SELECT * FROM full_black",
    "search_terms": """
SELECT request_id, unnest(terms) AS term FROM requests WHERE terms IS NOT NULL
UNION ALL SELECT concat('part ', p_partkey), unnest(list_distinct(string_split(regexp_replace(p_name, ' +$', ''), ' '))) FROM part""",
    "candidates_factor": "SELECT * FROM factor_cand",
    "candidates_overlap": "SELECT * FROM overlap_cand",
    "whitelist_filter": "SELECT c.* FROM factor_cand c JOIN requests r USING (request_id) WHERE r.white_list IS NOT NULL",
    "brand_filter": "SELECT c.* FROM factor_cand c JOIN requests r USING (request_id) WHERE r.brand IS NOT NULL",
    "category_filter": "SELECT c.* FROM factor_cand c JOIN requests r USING (request_id) WHERE r.categories IS NOT NULL",
    "search_cosmetic": "SELECT c.* FROM factor_cand c JOIN requests r USING (request_id) WHERE r.item_type = 'cosmetic' AND r.search IS NOT NULL",
    "search_content_factor": "SELECT c.* FROM factor_cand c JOIN requests r USING (request_id) WHERE r.item_type = 'content' AND r.cosmetic IS NULL AND r.categories IS NULL",
    "search_content_overlap": "SELECT c.* FROM overlap_cand c JOIN requests r USING (request_id) WHERE r.item_type = 'content' AND r.cosmetic IS NULL AND r.categories IS NULL",
    "related_cosmetic": "SELECT c.* FROM factor_cand c JOIN requests r USING (request_id) WHERE r.item_type = 'content' AND r.cosmetic IS NOT NULL",
    "owned_set": "SELECT * FROM owned",
    "overlap_score": "SELECT * FROM overlap",
    "item_model": """
SELECT item_id, item_type, f IS NOT NULL AS has_features, popularity FROM item_model""",
    "id_dictionary": """
SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS uidx
FROM (SELECT DISTINCT user_id FROM a_total)""",
    "profile": """
SELECT 'users' AS table_name, count(*) AS n_rows, min(user_id) AS first_key, max(user_id) AS last_key FROM users
UNION ALL SELECT 'items', count(*), min(item_id), max(item_id) FROM items
UNION ALL SELECT 'view', count(*), min(user_id || '|' || item_id), max(user_id || '|' || item_id)
  FROM tlog WHERE event = 'view'
UNION ALL SELECT 'own', count(*), min(user_id || '|' || item_id), max(user_id || '|' || item_id)
  FROM tlog WHERE event = 'own'
UNION ALL SELECT 'scrap', count(*), min(user_id || '|' || item_id), max(user_id || '|' || item_id)
  FROM tlog WHERE event IN ('scrap', 'cancel_scrap')
UNION ALL SELECT 'rate', count(*), min(user_id || '|' || item_id), max(user_id || '|' || item_id)
  FROM tlog WHERE event = 'rate'
UNION ALL SELECT 'play', count(*), min(user_id || '|' || item_id), max(user_id || '|' || item_id)
  FROM tlog WHERE event = 'play'""",
    "route": "SELECT request_id, route FROM routes",
    "popular_topn": _top("SELECT * FROM pop_scored"),
    "known_user_topn": _top("SELECT * FROM known_scored WHERE score > 0"),
    "similar_topn": _top("SELECT * FROM similar_scored WHERE score > 0"),
    "recommend_factor": _top(_RECOMM),
    "overlap_scorer": _top("SELECT * FROM o_scored WHERE NOT EXISTS (SELECT 1 FROM own_black b "
                           "WHERE b.request_id = o_scored.request_id AND b.item_id = o_scored.item_id)"),
    "recommend_blended": _top(f"""
  SELECT request_id, item_id, sum(score) AS score FROM (
    {_RECOMM_TOP}
    UNION ALL
    SELECT request_id, item_id, score FROM ({_COO_TOP.replace('FROM o_scored x', 'FROM (SELECT * FROM o_scored WHERE NOT EXISTS (SELECT 1 FROM own_black b WHERE b.request_id = o_scored.request_id AND b.item_id = o_scored.item_id)) x')})
  ) GROUP BY request_id, item_id"""),
}

BODIES["result_sink"] = _top("SELECT * FROM pop_scored")
BODIES["result_nested"] = f"""
SELECT request_id, string_agg(concat(item_id, '=', CAST(round(score * 1000, 0) AS BIGINT)), '|' ORDER BY rank) AS results
FROM ({BODIES["recommend_blended"]}) GROUP BY request_id"""
BODIES["als_user_factors"] = "SELECT DISTINCT user_id, 10 AS rank FROM a_total"
BODIES["als_item_factors"] = "SELECT DISTINCT item_id, 10 AS rank FROM a_total"
BODIES["als_residuals"] = "SELECT count(DISTINCT user_id) AS users, 0::BIGINT AS broken FROM a_total"
BODIES["als_recommend"] = """
SELECT 0::BIGINT AS wrong_type, 0::BIGINT AS beyond_num, 0::BIGINT AS black_listed, 0::BIGINT AS gaps"""
BODIES["score_hook_popular"] = _top("SELECT request_id, item_id, 1.0::DOUBLE - score AS score FROM pop_scored")
BODIES["affinity_other_weights"] = """
SELECT user_id, item_id, sum(rating) AS rating FROM (
  SELECT coalesce(o.user_id, r.user_id) AS user_id, coalesce(o.item_id, r.item_id) AS item_id,
         CASE WHEN o.rating IS NOT NULL AND r.rating IS NOT NULL THEN o.rating * r.rating ELSE coalesce(o.rating, r.rating) END AS rating
  FROM (SELECT user_id, item_id, rating / 3.0 * 7.0 AS rating FROM a_own) o
  FULL OUTER JOIN a_rate r ON o.user_id = r.user_id AND o.item_id = r.item_id
  UNION ALL SELECT user_id, item_id, rating * 2.0 FROM a_view
  UNION ALL SELECT user_id, item_id, rating / 5.0 * 0.5 FROM a_play
  UNION ALL SELECT user_id, item_id, CASE WHEN rating = 2.0 THEN -1.0 ELSE 0.0 END FROM a_scrap) GROUP BY user_id, item_id"""
BODIES["similar_events_by_type"] = _top("""
  SELECT * FROM similar_scored WHERE score > 0 AND request_id IN (SELECT request_id FROM requests WHERE item_type <> 'cosmetic')
  UNION ALL
  SELECT c.request_id, c.item_id,
         sum(list_dot_product(rv.f, m.f) / (sqrt(list_dot_product(rv.f, rv.f)) * sqrt(list_dot_product(m.f, m.f)))) AS score
  FROM factor_cand c JOIN requests r ON r.request_id = c.request_id AND r.item_type = 'cosmetic'
  JOIN (SELECT o.user_id, v.f FROM (
          SELECT DISTINCT user_id, item_id FROM (
            SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
            FROM log WHERE event = 'own' AND target_type = 'cosmetic') WHERE rn <= 10) o
        JOIN item_vecs v ON o.item_id = v.item_id) rv ON rv.user_id = r.user_id
  JOIN item_model m ON c.item_id = m.item_id
  WHERE m.f IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM full_black b WHERE b.request_id = c.request_id AND b.item_id = c.item_id)
  GROUP BY c.request_id, c.item_id HAVING score > 0""")

# sources: what is read back equals what was written
BODIES["events_json_source"] = """
SELECT event_id, event, user_id, target_type, item_id, rating, epoch_us(ts) AS ts_us FROM log"""
BODIES["property_fold_incremental"] = BODIES["property_fold"]
BODIES["property_events_json_source"] = BODIES["property_fold"]
BODIES["events_json_mixed"] = """
SELECT event, user_id, item_id, count(*) + count(*) FILTER (WHERE event_id % 2 = 0) AS n,
       count(*) + count(*) FILTER (WHERE event_id % 2 = 0) AS n_ids FROM log GROUP BY event, user_id, item_id"""
BODIES["training_from_events"] = "SELECT * FROM a_total"
BODIES["requests_json_anonymous"] = """
SELECT concat('u', o_custkey) AS user_id, 3 AS num, o_orderpriority AS search, count(*) AS n_requests
FROM orders GROUP BY ALL"""
BODIES["requests_json_source"] = """
SELECT request_id, user_id, num, item_type, search, result_type, cosmetic, brand,
       array_to_string(list_sort(categories), '|') AS categories_text,
       array_to_string(list_sort(white_list), '|') AS white_text,
       array_to_string(list_sort(black_list), '|') AS black_text
FROM requests
UNION ALL SELECT concat('r_', user_id), user_id, 10, 'cosmetic', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM users"""
BODIES["model_tables_roundtrip"] = BODIES["item_model"]

BODIES["model_tables_compared"] = "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*)::BIGINT AS n_rows, 0::BIGINT AS n_lost, 0::BIGINT AS n_added FROM {table}"
    for name, table in (("user_factors", "user_vecs"), ("item_model", "item_model"), ("owned", "owned"), ("mentions", "mentions")))

_EVENT_SAMPLE = "(SELECT '{0}' AS table_name, concat_ws('|', user_id, item_id, event_id) AS sample FROM tlog WHERE event IN ({1}) ORDER BY user_id, item_id, event_id LIMIT 2)"
BODIES["profile_samples"] = "\nUNION ALL ".join(
    ["(SELECT 'users' AS table_name, user_id AS sample FROM users ORDER BY user_id LIMIT 2)",
     "(SELECT 'items', item_id FROM items ORDER BY item_id LIMIT 2)"]
    + [_EVENT_SAMPLE.format(e, f"'{e}', 'cancel_scrap'" if e == "scrap" else f"'{e}'") for e in ("view", "own", "scrap", "rate", "play")])

_GUARD = "SELECT '{0}' AS table_name, count(*) > 0 AS passes, CASE WHEN count(*) = 0 THEN '{0} cannot be empty' END AS message FROM {1}"
BODIES["nonempty_guards"] = "\nUNION ALL ".join(
    _GUARD.format(*x) for x in (("users", "users"), ("items", "items"), ("views", "tlog WHERE event = 'view'"),
                                ("nothing", "items WHERE item_type = 'none'")))

BODIES["null_cosmetic_names"] = """
SELECT item_id,
  len(list_filter(list_prepend(NULL, cosmetics), lambda c: c IS NOT NULL AND fits(c, list_min(cosmetics)))) > 0 AS own,
  len(list_filter(list_prepend(NULL, cosmetics), lambda c: c IS NOT NULL AND c <> list_min(cosmetics) AND fits(c, list_min(cosmetics)))) > 0 AS others,
  false AS none
FROM items WHERE item_type = 'content' AND len(cosmetics) > 0""".replace(
    "fits(c, list_min(cosmetics))",
    "len(list_filter(string_split(list_min(cosmetics), ' '), lambda t: NOT contains(replace(c, ' ', ''), t))) = 0")

# the streaming operators end in the same state as their batch twins
BODIES["live_seen"] = BODIES["seen_items"]
BODIES["live_recent"] = BODIES["recent_items"]
BODIES["live_constraint"] = BODIES["unavailable_items"]
BODIES["live_popularity"] = BODIES["popularity_total"]


def oracle_sql() -> dict[str, str]:
    ctes = (BASE_CTES.replace("__REQUESTS__", _request_values()).replace("__CONSTRAINTS__", _constraint_values())
            .replace("__CYCLE__", str(CONSTRAINT_CYCLE)))
    return {name: f"WITH {ctes.strip()}\n{body.strip()}" for name, body in BODIES.items()}
