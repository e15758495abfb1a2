"""The recommender's input tables, derived from the test tables.

An order is a session, a part is an item; the last line of an order with two
or more lines is the purchase, every other line is a view.  Sessions whose id
ends in 0 form the test split.  Parts are the featured catalogue; a fixed
rule marks the candidate items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwalk.operators.ids import dense_index, join_small
from cartwalk.session import materialize, tasks_for
from cartwalk.sources.tables import Tables

EARLY_TRAIN_CUT = "1995-06-01 00:00:00"

# Lines that one task tags.
LINE_ROWS = 2_000_000


class Roles:
    """Builds the role DataFrames lazily from a ``Tables`` accessor."""

    def __init__(self, tables: Tables):
        self.t = tables
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    # -- sessions -----------------------------------------------------------
    def lines_tagged(self) -> DataFrame:
        """Each line with ``is_purchase``.

        The purchase is found with a ``max(struct)`` per order and a join back, not a
        per-order window.  Lines are shuffled by order once, for both: an order has few lines
        in a task's file, so aggregating there first would shuffle nearly all of them again.
        """
        def build():
            li = self.t.lineitem.select(
                F.col("l_orderkey").alias("session_id"),
                F.col("l_partkey").alias("item_id"),
                F.col("l_shipdate").alias("date"),
                "l_linenumber", "l_extendedprice",
            ).filter(F.col("session_id").isNotNull()).repartition(*tasks_for(self.t.lineitem, LINE_ROWS), "session_id")
            order_key = F.struct(
                F.col("date"), F.col("l_linenumber"), F.col("item_id"), F.col("l_extendedprice"))
            last = li.groupBy("session_id").agg(
                F.count(F.lit(1)).alias("n_lines"),
                F.max(order_key).alias("last_line"),
            )
            return (
                li.join(last, "session_id")
                .select(
                    "session_id", "item_id", "date",
                    ((F.col("n_lines") >= 2) & (order_key == F.col("last_line"))).alias("is_purchase"),
                )
            )
        return self._get("lines_tagged", build)

    def purchases(self) -> DataFrame:
        return self._get("purchases", lambda: self.lines_tagged()
                         .filter("is_purchase").select("session_id", "item_id", "date"))

    def views(self) -> DataFrame:
        return self._get("views", lambda: self.lines_tagged()
                         .filter(~F.col("is_purchase")).select("session_id", "item_id", "date"))

    def train_lines(self) -> DataFrame:
        """Train views and purchases in one pass over the tagged lines
        (session, item, date, is_purchase) - the merged form of S1 without a
        union of two branches."""
        return self.lines_tagged().filter(F.col("session_id") % 10 != 0)

    def train_views(self) -> DataFrame:
        return self.views().filter(F.col("session_id") % 10 != 0)

    def train_purchases(self) -> DataFrame:
        return self.purchases().filter(F.col("session_id") % 10 != 0)

    def test_views(self) -> DataFrame:
        return self.views().filter(F.col("session_id") % 10 == 0)

    def test_purchases(self) -> DataFrame:
        return self.purchases().filter(F.col("session_id") % 10 == 0)

    def early_train(self) -> DataFrame:
        return self.train_views().filter(F.col("date") < F.lit(EARLY_TRAIN_CUT).cast("timestamp_ntz"))

    # -- catalogue ----------------------------------------------------------
    def candidate_items(self) -> DataFrame:
        return self.t.part.select(F.col("p_partkey").alias("item_id")).filter(F.col("item_id") % 5 != 0)

    def featured_items(self) -> DataFrame:
        return self.t.part.select(F.col("p_partkey").alias("item_id"))

    def feature_values(self) -> DataFrame:
        """Long form (item, category id, category literal, value literal):
        one scan of ``part`` unpivoted with ``stack``."""
        p = self.t.part
        return p.select(
            F.col("p_partkey").alias("item_id"),
            F.expr(
                "stack(5, "
                "55, 'brand', p_brand, "
                "72, 'type', p_type, "
                "30, 'colour', split_part(p_name, ' ', 1), "
                "68, 'product', split_part(p_name, ' ', 2), "
                "50, 'size', CAST(p_size AS STRING)"
                ") AS (feature_category_id, feature_category_literal, feature_value_literal)"
            ),
        )

    def value_ids(self) -> DataFrame:
        def build():
            d = self.feature_values().select("feature_category_id", "feature_value_literal").distinct()
            return materialize(dense_index(d, ["feature_category_id", "feature_value_literal"], "feature_value_id", start=1))
        return self._get("value_ids", build)

    def item_features(self) -> DataFrame:
        def build():
            f = self.feature_values()
            hidden = (F.col("feature_category_id") == 50) | (
                (F.col("item_id") + F.col("feature_category_id")) % 7 == 0)
            return (
                join_small(f, self.value_ids(), ["feature_category_id", "feature_value_literal"])
                .select(
                    "item_id", "feature_category_id", "feature_value_id",
                    F.when(~hidden, F.col("feature_category_literal")).alias("feature_category_literal"),
                    F.when(~hidden, F.col("feature_value_literal")).alias("feature_value_literal"),
                )
            )
        return self._get("item_features", build)

    # -- event stream -------------------------------------------------------
    def event_interactions(self) -> DataFrame:
        return (
            self.t.events.filter(F.col("event_type").isin("view", "click", "purchase"))
            .select(
                F.col("user_id").alias("session_id"),
                F.get_json_object("props", "$.k").cast("int").cast("long").alias("item_id"),
                F.col("ts").alias("date"),
                "event_type", "event_id",
            )
        )
