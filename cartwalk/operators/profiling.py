"""Data profiling: summaries, integrity checks, distributions, time profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwalk.functions.exprs import r6
from cartwalk.operators.ids import with_scalar


def cold_report(urm: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """R2: items and users without any stored interaction."""
    it = items.select("item_id").distinct()
    cold_items = it.join(urm.select("item_id").distinct(), "item_id", "left_anti")
    us = users.select("session_id").distinct()
    cold_users = us.join(urm.select("session_id").distinct(), "session_id", "left_anti")
    a = cold_items.agg(F.count(F.lit(1)).alias("n_cold_items"))
    b = it.agg(F.count(F.lit(1)).alias("n_items"))
    c = cold_users.agg(F.count(F.lit(1)).alias("n_cold_users"))
    d = us.agg(F.count(F.lit(1)).alias("n_users"))
    return (with_scalar(with_scalar(with_scalar(a, b), c), d)
            .select("n_cold_items", "n_items",
                    r6(F.lit(100.0) * F.col("n_cold_items") / F.col("n_items")).alias("pct_cold_items"),
                    "n_cold_users", "n_users",
                    r6(F.lit(100.0) * F.col("n_cold_users") / F.col("n_users")).alias("pct_cold_users")))


def _n(col="*"):
    return F.count(F.lit(1)) if col == "*" else F.countDistinct(col)


def prof_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, does any cell hold null."""
    out = None
    for name, df in tables.items():
        any_null = F.lit(False)
        for c in df.columns:
            any_null = any_null | F.col(c).isNull()
        row = df.agg(F.coalesce(F.bool_or(any_null), F.lit(False)).alias("has_null")).select(
            F.lit(name).alias("table_name"), "has_null")
        out = row if out is None else out.unionByName(row)
    return out


def interaction_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct sessions and items, id ranges."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("session_id").alias("n_sessions"),
        F.countDistinct("item_id").alias("n_items"),
        F.min("session_id").alias("min_session"), F.max("session_id").alias("max_session"),
        F.min("item_id").alias("min_item"), F.max("item_id").alias("max_item"))


def catalogue_summary(candidates: DataFrame, featured: DataFrame) -> DataFrame:
    """Distinct candidates; distinct featured items and their id range."""
    a = candidates.agg(F.countDistinct("item_id").alias("n_candidates"))
    b = featured.agg(F.countDistinct("item_id").alias("n_featured"),
                     F.min("item_id").alias("min_featured"), F.max("item_id").alias("max_featured"))
    return with_scalar(a, b)


def date_range(df: DataFrame) -> DataFrame:
    """P5: first and last date."""
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def session_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two tables hold the same sessions (full outer join of ids)."""
    x = a.select("session_id").distinct().withColumn("_a", F.lit(1))
    y = b.select("session_id").distinct().withColumn("_b", F.lit(1))
    j = x.join(y, "session_id", "full_outer")
    return j.agg(
        F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).cast("long").alias("only_left"),
        F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).cast("long").alias("only_right"),
        F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).cast("long").alias("both"),
    ).withColumn("same_sessions", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def bought_viewed(views: DataFrame, purchases: DataFrame) -> DataFrame:
    """Sessions whose purchased item also appears among their views."""
    return purchases.select("session_id", "item_id").join(
        views.select("session_id", "item_id"), ["session_id", "item_id"], "left_semi"
    ).select("session_id").distinct()


def view_after_purchase(inter: DataFrame) -> DataFrame:
    """Views dated after the session's first purchase.  The purchase
    date is a per-session minimum (partial aggregate), so no view x purchase
    pairs are formed."""
    first = inter.filter(F.col("event_type") == "purchase").groupBy("session_id").agg(
        F.min("date").alias("purchase_date"))
    v = inter.filter(F.col("event_type") != "purchase")
    return v.join(first, "session_id").filter(F.col("date") > F.col("purchase_date")).select(
        "session_id", "event_id", "item_id", "date", "purchase_date")


def feature_cardinality(f: DataFrame) -> DataFrame:
    """P9."""
    return f.agg(F.countDistinct("feature_category_id").alias("n_categories"),
                 F.countDistinct("feature_value_id").alias("n_values"))


def count_distinct_by(f: DataFrame, key: str, what: str, alias: str) -> DataFrame:
    """Distinct ``what`` per ``key``."""
    return f.groupBy(key).agg(F.countDistinct(what).alias(alias))


def items_per_value_top(f: DataFrame, n: int = 100) -> DataFrame:
    """Distinct items per value, the first ``n`` by count (ties: id)."""
    return (count_distinct_by(f, "feature_value_id", "item_id", "n_items")
            .orderBy(F.col("n_items").desc(), F.col("feature_value_id")).limit(n))


def cats_per_item_stats(f: DataFrame) -> DataFrame:
    """Max, min, rounded mean and median of categories per item."""
    c = count_distinct_by(f, "item_id", "feature_category_id", "n_cats")
    return c.agg(F.max("n_cats").alias("max_cats"), F.min("n_cats").alias("min_cats"),
                 F.bround(F.avg("n_cats"), 0).alias("avg_cats"),
                 F.median("n_cats").cast("double").alias("median_cats"))


def multi_category_values(f: DataFrame) -> DataFrame:
    """Value literals used by more than one category."""
    return (f.filter(F.col("feature_value_literal").isNotNull())
            .groupBy("feature_value_literal")
            .agg(F.countDistinct("feature_category_id").alias("n_categories"))
            .filter(F.col("n_categories") > 1))


def items_without(featured: DataFrame, *tables: DataFrame) -> DataFrame:
    """Featured items absent from every given table (anti-joins)."""
    out = featured.select("item_id").distinct()
    for t in tables:
        out = out.join(t.select("item_id"), "item_id", "left_anti")
    return out


def items_cold_union(featured: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Featured minus (a union b)."""
    used = a.select("item_id").unionByName(b.select("item_id"))
    return featured.select("item_id").distinct().join(used, "item_id", "left_anti")


def repeat_share(views: DataFrame) -> DataFrame:
    """% of sessions that view the same item twice."""
    rep = (views.groupBy("session_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col("n") > 1).select("session_id").distinct()
           .agg(F.count(F.lit(1)).alias("n_rep")))
    tot = views.agg(F.countDistinct("session_id").alias("n_sessions"))
    return with_scalar(rep, tot).select(
        "n_rep", "n_sessions", r6(F.lit(100.0) * F.col("n_rep") / F.col("n_sessions")).alias("pct"))


def session_length(views: DataFrame) -> DataFrame:
    """P19."""
    return views.groupBy("session_id").agg(F.count(F.lit(1)).alias("length"))


def length_hist(views: DataFrame) -> DataFrame:
    """P20."""
    return session_length(views).groupBy("length").agg(F.count(F.lit(1)).alias("n_sessions"))


def length_stats(views: DataFrame) -> DataFrame:
    """Mean, median, mode (most frequent, smallest on ties), max, min."""
    lens = session_length(views)
    mode = (length_hist(views).orderBy(F.col("n_sessions").desc(), F.col("length").asc())
            .limit(1).select(F.col("length").alias("mode_length")))
    st = lens.agg(r6(F.avg("length")).alias("mean_length"),
                  F.median("length").cast("double").alias("median_length"),
                  F.max("length").alias("max_length"), F.min("length").alias("min_length"))
    return with_scalar(st, mode)


# Period, weekday and month labels used by the time profiles.
PERIOD_LABELS = ["00:00 - 03:59", "04:00 - 07:59", "08:00 - 11:59",
                 "12:00 - 15:59", "16:00 - 19:59", "20:00 - 23:59"]
WEEKDAYS = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo", "Media"]
MONTHS = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto",
          "Septiembre", "Octubre", "Noviembre", "Diciembre", "Media"]


def year_split(p: DataFrame, cut: str) -> DataFrame:
    """Purchases up to / after a cut timestamp."""
    ts = F.lit(cut).cast("timestamp_ntz")
    return p.groupBy(F.when(F.col("date") <= ts, "up_to").otherwise("after").alias("side")).agg(
        F.count(F.lit(1)).alias("n_purchases"))


def in_year(p: DataFrame, year: int) -> DataFrame:
    return p.filter((F.col("date") >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz"))
                    & (F.col("date") < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz")))


def _year() -> Column:
    return F.year("date").cast("long").alias("year")


def period_4h(p: DataFrame) -> DataFrame:
    """Distinct sessions per year and 4-hour period label."""
    idx = (F.floor(F.hour("date") / 4) + 1).cast("int")
    labels = F.array(*[F.lit(x) for x in PERIOD_LABELS])
    return p.groupBy(_year(), F.element_at(labels, idx).alias("period")).agg(
        F.countDistinct("session_id").alias("n_sessions"))


def per_hour(p: DataFrame) -> DataFrame:
    """Distinct sessions per year and zero-padded hour label."""
    h = F.lpad(F.hour("date").cast("string"), 2, "0")
    label = F.concat(h, F.lit(":00 - "), h, F.lit(":59"))
    return p.groupBy(_year(), label.alias("hour")).agg(F.countDistinct("session_id").alias("n_sessions"))


def weekend_share(p: DataFrame) -> DataFrame:
    """P25: share of purchases on Saturday or Sunday."""
    return p.agg(r6(F.avg((F.weekday("date") >= 5).cast("double"))).alias("weekend_share"))


def _on_spine(p: DataFrame, idx: Column, labels: list[str]) -> DataFrame:
    """Counts per year on a spine of labels, zero where there are none: (year,
    idx, label, n).  Every year that occurs gets the whole spine."""
    counts = p.groupBy(_year(), idx.cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    spine = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(x).alias("label")) for i, x in enumerate(labels)])
    years = p.select(_year()).distinct().select("year", F.explode(spine).alias("s")).select("year", "s.idx", "s.label")
    return years.join(counts, ["year", "idx"], "left").select(
        "year", "idx", "label", F.coalesce("n", F.lit(0)).cast("double").alias("n"))


def per_weekday(p: DataFrame) -> DataFrame:
    """Purchases per year and weekday on a 7-row spine plus their rounded
    mean."""
    days = _on_spine(p, F.weekday("date"), WEEKDAYS[:7])
    mean = days.groupBy("year").agg(F.bround(F.avg("n"), 0).alias("n")).select(
        "year", F.lit(7).alias("idx"), F.lit(WEEKDAYS[7]).alias("label"), "n")
    return days.unionByName(mean).withColumnRenamed("label", "day")


def per_month(p: DataFrame) -> DataFrame:
    """Purchases per year and month on a 12-row spine plus their mean."""
    months = _on_spine(p, F.month("date") - 1, MONTHS[:12])
    mean = months.groupBy("year").agg(r6(F.avg("n")).alias("n")).select(
        "year", F.lit(12).alias("idx"), F.lit(MONTHS[12]).alias("label"), "n")
    return months.unionByName(mean).withColumnRenamed("label", "month")


def top_items_per_month(p: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most bought items of each month of each year (ties:
    smaller id)."""
    from pyspark.sql import Window
    c = p.groupBy(_year(), F.month("date").cast("long").alias("month"), "item_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("year", "month").orderBy(F.col("n").desc(), F.col("item_id"))
    return c.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).withColumn(
        "pos", F.col("pos").cast("long"))
