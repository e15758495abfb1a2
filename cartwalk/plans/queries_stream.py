"""Registered queries: Structured Streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwalk.functions.exprs import r6
from cartwalk.operators import ranking as RK
from cartwalk.plans import recommend as P
from cartwalk.plans.queries_rec import REC, TRAIN, W20
from cartwalk.plans.queries_session import ACC
from cartwalk.plans.registry import query
from cartwalk.plans.sqlroles import R6, with_roles
from cartwalk.session import materialize
from cartwalk.streaming import sessions as ST


@query("stream_session", with_roles("""
SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS turn, added AS added_item, CAST(len(list_filter(items, lambda x: x IS NOT NULL)) AS BIGINT) AS session_size
FROM walk""", ACC))
def stream_session(ctx):
    """Keyed-state session accumulation over every user turn of every
    conversation (messages applied in turn order)."""
    from cartwalk.plans.queries_text import top_items
    top = top_items(ctx).select(F.col("conv_id").alias("session_id"), "turn", "item_id", "rank")
    return ST.stream_session(ctx.spark, top)


@query("stream_recommend", with_roles("SELECT session_id, item_id, rank FROM t_top", REC))
def stream_recommend(ctx):
    """Micro-batches of test views scored against the fitted W."""
    # Rows of the model without the columns that every batch would leave out, stored as the batches read them.
    W = materialize(RK.model_rows(P.fit_w(ctx, store=False)(materialize(P.excluded(ctx).distinct()))))

    def rec(batch):
        prof = P.views_profile(batch)
        return P.recommend(ctx, prof, lambda blocked: W, 10).select("session_id", "item_id", "rank")
    return ST.stream_recommend(ctx.spark, ctx.r.test_views(), rec).select("session_id", "item_id", "rank")


@query("stream_model", with_roles(f"SELECT item_i, item_j, {R6('sim')} AS sim FROM m_w", TRAIN + "," + W20))
def stream_model(ctx):
    """W after the last micro-batch of the train lines, which arrive in
    time order; sessions go on over several batches."""
    lines = ctx.r.train_lines().select("session_id", "item_id", "date", "is_purchase")
    models = ST.stream_model(ctx.spark, lines, P.views_profile, topK=P.TOPK)
    newest = models.agg(F.max("batch_id").alias("batch_id"))
    return models.join(newest, "batch_id").select("item_i", "item_j", r6("sim").alias("sim"))


@query("stream_window_4h")
def stream_window_4h(ctx):
    """Approximate distinct purchasing sessions per 4-hour window."""
    ev = ctx.r.event_interactions().filter(F.col("event_type") == "purchase")
    return ST.stream_window_4h(ctx.spark, ev)


@query("stream_dedup_last", with_roles("""
SELECT session_id, item_id, date, event_id FROM event_interactions
QUALIFY row_number() OVER (PARTITION BY session_id, item_id ORDER BY date DESC, event_id DESC) = 1"""))
def stream_dedup_last(ctx):
    """Keep-last per (session, item) over the event stream."""
    return ST.stream_dedup_last(ctx.spark, ctx.r.event_interactions())
