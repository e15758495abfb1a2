"""Validated parameter sweep with patience.

The pairs of items are formed once, with one sum for each alpha of the grid; a
round takes its W from these sums, recommends for the validation sessions and
evaluates.  The only driver-side read is one scalar a validated round, and the
number of rounds is bounded by the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartwalk.operators import evaluation as EV
from cartwalk.operators import pairsums as PS
from cartwalk.operators import walk as WK
from cartwalk.plans import recommend as P
from cartwalk.session import materialize

SCHEMA = T.StructType([
    T.StructField("round", T.LongType()), T.StructField("alpha", T.DoubleType()),
    T.StructField("beta", T.DoubleType()), T.StructField("topk", T.LongType()),
    T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("is_best", T.BooleanType()), T.StructField("stopped", T.BooleanType()),
])


def sweep(ctx, grid, metric: str = "MAP", cutoff: int = 10, patience: int = 2, check_every: int = 1) -> DataFrame:
    """One row for each validated round.  Every ``check_every``-th point of
    ``grid`` (alpha, beta, topk) is validated; the sweep stops after
    ``patience`` validations in a row without a new best.  Rounds that are not
    validated cost nothing.  A metric that is no number ends the sweep with
    an error."""
    from cartwalk.plans.queries_eval import eval_inputs
    checked = [(rnd, *point) for rnd, point in enumerate(grid, start=1) if rnd % check_every == 0]
    if not checked:
        return ctx.spark.createDataFrame([], SCHEMA)
    urm, prof = P.train_urm(ctx), P.test_profile(ctx)
    alphas = sorted({float(a) for _, a, _, _ in checked})
    sums = materialize(PS.pair_sums(urm, alphas))
    pops = materialize(WK.item_stats(urm))
    rows, best, worse = [], None, 0
    for rnd, alpha, beta, topk in checked:
        W = materialize(PS.fit_from_sums(sums, pops, alpha, beta, topk, column=f"c{alphas.index(float(alpha))}"))
        wide = EV.evaluate(eval_inputs(ctx, ranking=P.recommend(ctx, prof, W, cutoff), cutoffs=[cutoff], div=False))
        value = float(wide.select(metric).first()[0] or 0.0)
        if not math.isfinite(value):
            raise ValueError(f"round {rnd}: {metric} is {value}")
        if best is None or value > best[0]:
            best, worse = (value, rnd), 0
        else:
            worse += 1
        rows.append((rnd, float(alpha), float(beta), int(topk), metric, value, worse >= patience))
        if worse >= patience:
            break
    return ctx.spark.createDataFrame([r[:6] + (r[0] == best[1], r[6]) for r in rows], SCHEMA)
