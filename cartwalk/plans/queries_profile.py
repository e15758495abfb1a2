"""Registered queries: data profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwalk.functions.exprs import r6
from cartwalk.operators import profiling as PR
from cartwalk.plans.registry import query
from cartwalk.plans.sqlroles import R6, with_roles

CUT = "1996-12-31 23:59:59"


@query("prof_nulls", with_roles("""
SELECT 'views' AS table_name, coalesce(bool_or(session_id IS NULL OR item_id IS NULL OR date IS NULL), FALSE) AS has_null FROM views
UNION ALL SELECT 'purchases', coalesce(bool_or(session_id IS NULL OR item_id IS NULL OR date IS NULL), FALSE) FROM purchases
UNION ALL SELECT 'item_features', coalesce(bool_or(item_id IS NULL OR feature_category_id IS NULL OR feature_value_id IS NULL
  OR feature_category_literal IS NULL OR feature_value_literal IS NULL), FALSE) FROM item_features"""))
def prof_nulls(ctx):
    """Any-null check per table."""
    return PR.prof_nulls({"views": ctx.r.views(), "purchases": ctx.r.purchases(),
                          "item_features": ctx.r.item_features()})


SUMMARY = """SELECT count(*) AS n_rows, count(DISTINCT session_id) AS n_sessions, count(DISTINCT item_id) AS n_items,
  min(session_id) AS min_session, max(session_id) AS max_session, min(item_id) AS min_item, max(item_id) AS max_item FROM {}"""


@query("prof_views_summary", with_roles(SUMMARY.format("train_views")))
def prof_views_summary(ctx):
    """Summary of the train views."""
    return PR.interaction_summary(ctx.r.train_views())


@query("prof_purch_summary", with_roles(SUMMARY.format("train_purchases")))
def prof_purch_summary(ctx):
    """Summary of the train purchases."""
    return PR.interaction_summary(ctx.r.train_purchases())


@query("prof_catalogue", with_roles("""
SELECT (SELECT count(DISTINCT item_id) FROM candidate_items) AS n_candidates,
  count(DISTINCT item_id) AS n_featured, min(item_id) AS min_featured, max(item_id) AS max_featured FROM item_features"""))
def prof_catalogue(ctx):
    """Candidate and featured catalogue summary."""
    return PR.catalogue_summary(ctx.r.candidate_items(), ctx.r.item_features())


@query("prof_date_range", with_roles("SELECT min(date) AS first_date, max(date) AS last_date FROM train_views"))
def prof_date_range(ctx):
    """P5: first and last train view date."""
    return PR.date_range(ctx.r.train_views())


@query("prof_session_parity", with_roles("""
SELECT CAST(sum(CASE WHEN b.session_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_left,
  CAST(sum(CASE WHEN a.session_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_right,
  CAST(sum(CASE WHEN a.session_id IS NOT NULL AND b.session_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both,
  sum(CASE WHEN b.session_id IS NULL OR a.session_id IS NULL THEN 1 ELSE 0 END) = 0 AS same_sessions
FROM (SELECT DISTINCT session_id FROM test_views) a FULL OUTER JOIN (SELECT DISTINCT session_id FROM test_purchases) b
  ON a.session_id = b.session_id"""))
def prof_session_parity(ctx):
    """Do test views and test purchases hold the same sessions."""
    return PR.session_parity(ctx.r.test_views(), ctx.r.test_purchases())


@query("check_bought_viewed", with_roles("""
SELECT DISTINCT p.session_id FROM purchases p
WHERE EXISTS (SELECT 1 FROM views v WHERE v.session_id = p.session_id AND v.item_id = p.item_id)"""))
def check_bought_viewed(ctx):
    """Sessions whose purchased item was also viewed."""
    return PR.bought_viewed(ctx.r.views(), ctx.r.purchases())


@query("check_view_after_purchase", with_roles("""
SELECT v.session_id, v.event_id, v.item_id, v.date, f.purchase_date FROM event_interactions v
JOIN (SELECT session_id, min(date) AS purchase_date FROM event_interactions WHERE event_type = 'purchase' GROUP BY 1) f
  USING (session_id)
WHERE v.event_type <> 'purchase' AND v.date > f.purchase_date"""))
def check_view_after_purchase(ctx):
    """Views after the session's first purchase."""
    return PR.view_after_purchase(ctx.r.event_interactions())


@query("prof_feature_card", with_roles(
    "SELECT count(DISTINCT feature_category_id) AS n_categories, count(DISTINCT feature_value_id) AS n_values FROM item_features"))
def prof_feature_card(ctx):
    """Distinct categories and values."""
    return PR.feature_cardinality(ctx.r.item_features())


@query("prof_items_per_cat", with_roles(
    "SELECT feature_category_id, count(DISTINCT item_id) AS n_items FROM item_features GROUP BY 1"))
def prof_items_per_cat(ctx):
    """P10: distinct items per category."""
    return PR.count_distinct_by(ctx.r.item_features(), "feature_category_id", "item_id", "n_items")


@query("prof_values_per_cat", with_roles(
    "SELECT feature_category_id, count(DISTINCT feature_value_id) AS n_values FROM item_features GROUP BY 1"))
def prof_values_per_cat(ctx):
    """Distinct values per category."""
    return PR.count_distinct_by(ctx.r.item_features(), "feature_category_id", "feature_value_id", "n_values")


@query("prof_items_per_value", with_roles("""
SELECT feature_value_id, count(DISTINCT item_id) AS n_items FROM item_features GROUP BY 1
ORDER BY n_items DESC, feature_value_id LIMIT 100"""))
def prof_items_per_value(ctx):
    """Distinct items per value, top 100."""
    return PR.items_per_value_top(ctx.r.item_features(), 100)


@query("prof_cats_per_item", with_roles(
    "SELECT item_id, count(DISTINCT feature_category_id) AS n_cats FROM item_features GROUP BY 1"))
def prof_cats_per_item(ctx):
    """Distinct categories per item."""
    return PR.count_distinct_by(ctx.r.item_features(), "item_id", "feature_category_id", "n_cats")


@query("prof_cats_stats", with_roles("""
SELECT max(n_cats) AS max_cats, min(n_cats) AS min_cats, round_even(avg(n_cats), 0) AS avg_cats,
  CAST(median(n_cats) AS DOUBLE) AS median_cats
FROM (SELECT item_id, count(DISTINCT feature_category_id) AS n_cats FROM item_features GROUP BY 1)"""))
def prof_cats_stats(ctx):
    """Stats of categories per item."""
    return PR.cats_per_item_stats(ctx.r.item_features())


@query("prof_multi_cat_values", with_roles("""
SELECT feature_value_literal, count(DISTINCT feature_category_id) AS n_categories FROM item_features
WHERE feature_value_literal IS NOT NULL GROUP BY 1 HAVING count(DISTINCT feature_category_id) > 1"""))
def prof_multi_cat_values(ctx):
    """Value literals shared by several categories."""
    return PR.multi_category_values(ctx.r.item_features())


@query("items_no_interaction", with_roles("""
SELECT DISTINCT item_id FROM item_features
WHERE item_id NOT IN (SELECT item_id FROM train_views) AND item_id NOT IN (SELECT item_id FROM train_purchases)"""))
def items_no_interaction(ctx):
    """Featured items neither viewed nor bought in train."""
    return PR.items_without(ctx.r.item_features(), ctx.r.train_views(), ctx.r.train_purchases())


@query("items_cold", with_roles("""
SELECT DISTINCT item_id FROM item_features
WHERE item_id NOT IN (SELECT item_id FROM early_train UNION ALL SELECT item_id FROM test_views)"""))
def items_cold(ctx):
    """Featured minus (early train views union test views)."""
    return PR.items_cold_union(ctx.r.item_features(), ctx.r.early_train(), ctx.r.test_views())


@query("prof_repeat_share", with_roles(f"""
SELECT n_rep, n_sessions, {R6('100.0 * n_rep / n_sessions')} AS pct FROM
  (SELECT count(*) AS n_rep FROM (SELECT DISTINCT session_id FROM (
     SELECT session_id, item_id FROM event_interactions WHERE event_type = 'view' GROUP BY 1, 2 HAVING count(*) > 1))),
  (SELECT count(DISTINCT session_id) AS n_sessions FROM event_interactions WHERE event_type = 'view')"""))
def prof_repeat_share(ctx):
    """Share of sessions viewing the same item twice (event views)."""
    ev = ctx.r.event_interactions().filter(F.col("event_type") == "view")
    return PR.repeat_share(ev)


@query("prof_session_length", with_roles(
    "SELECT session_id, count(*) AS length FROM train_views GROUP BY 1"))
def prof_session_length(ctx):
    """Views per session."""
    return PR.session_length(ctx.r.train_views())


@query("prof_length_hist", with_roles(
    "SELECT length, count(*) AS n_sessions FROM (SELECT session_id, count(*) AS length FROM train_views GROUP BY 1) GROUP BY 1"))
def prof_length_hist(ctx):
    """P20: sessions by length."""
    return PR.length_hist(ctx.r.train_views())


@query("prof_length_stats", with_roles(f"""
SELECT {R6('avg(length)')} AS mean_length, CAST(median(length) AS DOUBLE) AS median_length,
  max(length) AS max_length, min(length) AS min_length,
  (SELECT length FROM l GROUP BY length ORDER BY count(*) DESC, length LIMIT 1) AS mode_length FROM l""",
    "l AS (SELECT session_id, count(*) AS length FROM train_views GROUP BY 1)"))
def prof_length_stats(ctx):
    """Session-length mean, median, mode, max, min."""
    return PR.length_stats(ctx.r.train_views())


@query("prof_year_split", with_roles(f"""
SELECT CASE WHEN date <= TIMESTAMP '{CUT}' THEN 'up_to' ELSE 'after' END AS side, count(*) AS n_purchases
FROM purchases GROUP BY 1"""))
def prof_year_split(ctx):
    """Purchases up to / after the end of 1996."""
    return PR.year_split(ctx.r.purchases(), CUT)


EV_PURCH = "(SELECT *, year(date) AS year FROM event_interactions WHERE event_type = 'purchase')"


def _ev_purchases(ctx):
    return ctx.r.event_interactions().filter(F.col("event_type") == "purchase")


@query("time_4h_period", with_roles(f"""
SELECT year, (['00:00 - 03:59', '04:00 - 07:59', '08:00 - 11:59', '12:00 - 15:59', '16:00 - 19:59', '20:00 - 23:59'])[hour(date) // 4 + 1] AS period,
  count(DISTINCT session_id) AS n_sessions FROM {EV_PURCH} GROUP BY 1, 2"""))
def time_4h_period(ctx):
    """Sessions with a purchase per year and 4-hour period."""
    return PR.period_4h(_ev_purchases(ctx))


@query("time_hour", with_roles(f"""
SELECT year, lpad(CAST(hour(date) AS VARCHAR), 2, '0') || ':00 - ' || lpad(CAST(hour(date) AS VARCHAR), 2, '0') || ':59' AS hour,
  count(DISTINCT session_id) AS n_sessions FROM {EV_PURCH} GROUP BY 1, 2"""))
def time_hour(ctx):
    """Sessions with a purchase per year and hour."""
    return PR.per_hour(_ev_purchases(ctx))


@query("time_weekend_share", with_roles(
    f"SELECT {R6('avg(CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END)')} AS weekend_share FROM purchases"))
def time_weekend_share(ctx):
    """P25: share of purchases on weekends."""
    return PR.weekend_share(ctx.r.purchases())


P_YEAR = "(SELECT *, year(date) AS year FROM purchases)"


@query("time_weekday", with_roles("""
SELECT year, idx, day, n FROM x UNION ALL SELECT year, 7, 'Media', round_even(avg(n), 0) FROM x GROUP BY year""", f"""
d AS (SELECT * FROM (VALUES (0, 'Lunes'), (1, 'Martes'), (2, 'Miércoles'), (3, 'Jueves'), (4, 'Viernes'), (5, 'Sábado'), (6, 'Domingo')) t(idx, day)),
c AS (SELECT year, isodow(date) - 1 AS idx, count(*) AS n FROM {P_YEAR} GROUP BY 1, 2),
x AS (SELECT y.year, d.idx, d.day, CAST(coalesce(c.n, 0) AS DOUBLE) AS n FROM (SELECT DISTINCT year FROM c) y CROSS JOIN d LEFT JOIN c USING (year, idx))"""))
def time_weekday(ctx):
    """Purchases per year and weekday plus the rounded mean."""
    return PR.per_weekday(ctx.r.purchases())


@query("time_month", with_roles(f"""
SELECT year, idx, month, n FROM x UNION ALL SELECT year, 12, 'Media', {R6('avg(n)')} FROM x GROUP BY year""", f"""
m AS (SELECT * FROM (VALUES (0, 'Enero'), (1, 'Febrero'), (2, 'Marzo'), (3, 'Abril'), (4, 'Mayo'), (5, 'Junio'), (6, 'Julio'),
  (7, 'Agosto'), (8, 'Septiembre'), (9, 'Octubre'), (10, 'Noviembre'), (11, 'Diciembre')) t(idx, month)),
c AS (SELECT year, month(date) - 1 AS idx, count(*) AS n FROM {P_YEAR} GROUP BY 1, 2),
x AS (SELECT y.year, m.idx, m.month, CAST(coalesce(c.n, 0) AS DOUBLE) AS n FROM (SELECT DISTINCT year FROM c) y CROSS JOIN m LEFT JOIN c USING (year, idx))"""))
def time_month(ctx):
    """Purchases per year and month plus the mean."""
    return PR.per_month(ctx.r.purchases())


@query("top5_month", with_roles(f"""
SELECT year, month, item_id, n, CAST(pos AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY n DESC, item_id) AS pos FROM (
    SELECT year, month(date) AS month, item_id, count(*) AS n FROM {P_YEAR} GROUP BY 1, 2, 3)) WHERE pos <= 5"""))
def top5_month(ctx):
    """Five most bought items per month of every year."""
    return PR.top_items_per_month(ctx.r.purchases(), 5)
