"""DuckDB SQL text used by the correctness oracles.

The role views are written once here and prepended to every oracle query, so
each oracle reads the raw test tables.  ``R6`` and ``RK`` mirror
``cartwalk.functions.exprs.r6`` / ``rank_key``.
"""

from __future__ import annotations


def R6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.500001) / 1e6)"


def RK(x: str) -> str:
    return f"floor(({x}) * 1e12 + 0.5)"


ROLE_CTES = """
lines_ordered AS (
  SELECT l_orderkey AS session_id, l_partkey AS item_id, l_shipdate AS date,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn_desc,
    count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
purchases AS (SELECT session_id, item_id, date FROM lines_ordered WHERE rn_desc = 1 AND n >= 2),
views AS (SELECT session_id, item_id, date FROM lines_ordered WHERE n = 1 OR rn_desc > 1),
train_views AS (SELECT * FROM views WHERE session_id % 10 <> 0),
train_purchases AS (SELECT * FROM purchases WHERE session_id % 10 <> 0),
test_views AS (SELECT * FROM views WHERE session_id % 10 = 0),
test_purchases AS (SELECT * FROM purchases WHERE session_id % 10 = 0),
early_train AS (SELECT * FROM train_views WHERE date < TIMESTAMP '1995-06-01 00:00:00'),
candidate_items AS (SELECT p_partkey AS item_id FROM part WHERE p_partkey % 5 <> 0),
featured_items AS (SELECT p_partkey AS item_id FROM part),
feature_values AS (
  SELECT p_partkey AS item_id, 55 AS feature_category_id, 'brand' AS feature_category_literal, p_brand AS feature_value_literal FROM part
  UNION ALL SELECT p_partkey, 72, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 30, 'colour', split_part(p_name, ' ', 1) FROM part
  UNION ALL SELECT p_partkey, 68, 'product', split_part(p_name, ' ', 2) FROM part
  UNION ALL SELECT p_partkey, 50, 'size', CAST(p_size AS VARCHAR) FROM part),
value_ids AS (
  SELECT feature_category_id, feature_value_literal,
    row_number() OVER (ORDER BY feature_category_id, feature_value_literal) AS feature_value_id
  FROM (SELECT DISTINCT feature_category_id, feature_value_literal FROM feature_values) d),
item_features AS (
  SELECT f.item_id, f.feature_category_id, v.feature_value_id,
    CASE WHEN f.feature_category_id = 50 OR (f.item_id + f.feature_category_id) % 7 = 0 THEN NULL ELSE f.feature_category_literal END AS feature_category_literal,
    CASE WHEN f.feature_category_id = 50 OR (f.item_id + f.feature_category_id) % 7 = 0 THEN NULL ELSE f.feature_value_literal END AS feature_value_literal
  FROM feature_values f JOIN value_ids v ON v.feature_category_id = f.feature_category_id AND v.feature_value_literal = f.feature_value_literal),
event_interactions AS (
  SELECT user_id AS session_id, CAST(CAST(json_extract_string(props, '$.k') AS INT) AS BIGINT) AS item_id, ts AS date, event_type, event_id
  FROM events WHERE event_type IN ('view', 'click', 'purchase'))
"""


def with_roles(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` (a SELECT, optionally starting with more CTEs given
    in ``extra_ctes``) with the role views."""
    ctes = ROLE_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip().rstrip(",")
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def keep_last(src: str, score: str) -> str:
    """Keep-last per (session, item): latest date, purchase wins ties."""
    return f"""(SELECT session_id, item_id, score FROM (
      SELECT session_id, item_id, {score} AS score,
        row_number() OVER (PARTITION BY session_id, item_id ORDER BY date DESC, is_purchase DESC, {score} DESC) AS _rn
      FROM {src}) WHERE _rn = 1)"""


# Interaction tables with weights (views 0.2, purchases 1.0), de-duplicated.
def urm_cte(name: str, views: str, purchases: str | None, view_w: float = 0.2,
            purch_w: float = 1.0) -> str:
    src = f"(SELECT session_id, item_id, date, FALSE AS is_purchase FROM {views}"
    if purchases:
        src += f" UNION ALL SELECT session_id, item_id, date, TRUE FROM {purchases}"
    src += ")"
    score = f"CASE WHEN is_purchase THEN {purch_w} ELSE {view_w} END"
    return f"""{name} AS (
  SELECT session_id, item_id, CAST(sum(score) AS DOUBLE) AS score FROM {keep_last(src, score)} k
  GROUP BY session_id, item_id HAVING sum(score) <> 0)"""


def walk_ctes(urm: str, prefix: str, topk: int = 100, alpha: float = 1.0, beta: float = 0.6,
              normalize: bool = True) -> str:
    """S, row cut, normalise, column cut as CTEs ``{prefix}_w``."""
    a = float(alpha)
    pui = "u.score / us.l1" if a == 1.0 else f"pow(u.score / us.l1, {a})"
    piu = "1.0::DOUBLE / ist.pop" if a == 1.0 else f"pow(1.0::DOUBLE / ist.pop, {a})"
    norm = (f"SELECT item_i, item_j, sim / sum(abs(sim)) OVER (PARTITION BY item_i) AS sim FROM {prefix}_r"
            if normalize else f"SELECT item_i, item_j, sim FROM {prefix}_r")
    return f"""
{prefix}_us AS (SELECT session_id, sum(abs(score)) AS l1 FROM {urm} GROUP BY session_id),
{prefix}_is AS (SELECT item_id, count(*) AS pop FROM {urm} GROUP BY item_id),
{prefix}_base AS (
  SELECT u.session_id, u.item_id, {pui} AS pui, {piu} AS piu, pow(ist.pop::DOUBLE, -{float(beta)}) AS degree
  FROM {urm} u JOIN {prefix}_us us USING (session_id) JOIN {prefix}_is ist USING (item_id)),
{prefix}_s AS (
  SELECT a.item_id AS item_i, b.item_id AS item_j, sum(a.piu * b.pui * b.degree) AS sim
  FROM {prefix}_base a JOIN {prefix}_base b ON a.session_id = b.session_id AND a.item_id <> b.item_id
  GROUP BY 1, 2),
{prefix}_r AS (
  SELECT item_i, item_j, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY {RK('sim')} DESC, item_j) AS rn
    FROM {prefix}_s WHERE sim <> 0) WHERE rn <= {topk}),
{prefix}_n AS ({norm}),
{prefix}_w AS (
  SELECT item_i, item_j, sim FROM (
    SELECT *, row_number() OVER (PARTITION BY item_j ORDER BY {RK('sim')} DESC, item_i) AS rn
    FROM {prefix}_n WHERE sim <> 0) WHERE rn <= {topk})
"""


def topk_ctes(prefix: str, prof: str, w: str, cutoff: int, excl: str | None = "excl_items",
              univ: str = "featured_items", remove_seen: bool = True, users: str | None = None) -> str:
    """Brute-force top-k: every (user, item) pair scored (zero when W gives
    nothing), seen and excluded removed, ranked by (score desc, item)."""
    users = users or f"(SELECT DISTINCT session_id FROM {prof})"
    seen = (f"AND NOT EXISTS (SELECT 1 FROM {prof} p WHERE p.session_id = u.session_id AND p.item_id = i.item_id)"
            if remove_seen else "")
    ex = f"AND i.item_id NOT IN (SELECT item_id FROM {excl})" if excl else ""
    return f"""
{prefix}_sc AS (
  SELECT p.session_id, w.item_j AS item_id, sum(p.score * w.sim) AS score
  FROM {prof} p JOIN {w} w ON p.item_id = w.item_i GROUP BY 1, 2),
{prefix}_n AS (SELECT count(DISTINCT item_id) AS n FROM {univ}),
{prefix}_all AS (
  SELECT u.session_id, i.item_id, coalesce(sc.score, 0.0) AS score
  FROM {users} u CROSS JOIN (SELECT DISTINCT item_id FROM {univ}) i
  LEFT JOIN {prefix}_sc sc ON sc.session_id = u.session_id AND sc.item_id = i.item_id
  WHERE TRUE {seen} {ex}),
{prefix}_top AS (
  SELECT session_id, item_id, CAST(rn AS BIGINT) AS rank, score FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {RK('score')} DESC, item_id) AS rn
    FROM {prefix}_all) WHERE rn <= least({cutoff}, (SELECT n FROM {prefix}_n) - 1))
"""


EXCL_CTE = """excl_items AS (
  SELECT DISTINCT item_id FROM featured_items WHERE item_id NOT IN (SELECT item_id FROM candidate_items))"""
