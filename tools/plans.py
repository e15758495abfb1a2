"""Write the physical plans of key operators to PLANS.md (sf0.01).

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartwalk.operators import ranking as RK  # noqa: E402
from cartwalk.operators import walk as WK  # noqa: E402
from cartwalk.plans import recommend as P  # noqa: E402
from cartwalk.plans.registry import Ctx, load_all  # noqa: E402
from cartwalk.session import get_spark  # noqa: E402


def plan_text(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    reg = load_all()
    ctx = Ctx(spark, sf)
    urm = P.train_urm(ctx)
    items = [
        ("Walk model fit (R7-R10) on the stored train matrix",
         "Partial aggregation of pair sums before the (i, j) exchange; WindowGroupLimit Partial "
         "before and Final after each top-k exchange; the salt generators of the grid on both sides.",
         WK.rp3_fit(urm, topK=20)),
        ("Ranking (R12-R16) on stored W and profile, without fill",
         "Profile joined to W on the item, partial aggregation on (session, item), anti-joins for "
         "seen and excluded items, WindowGroupLimit for the top 10.",
         RK.rec_topk(P.test_profile(ctx), P.fit_w(ctx), ctx.r.featured_items(), 10,
                     exclude=P.excluded(ctx), zero_fill=False)),
        ("time_4h_period (P23)", "Filters and column pruning reach the Parquet scan.",
         reg["time_4h_period"].build(spark, sf)),
        ("prof_views_summary (P2)", "Only the five lineitem columns the role needs are read.",
         reg["prof_views_summary"].build(spark, sf)),
    ]
    out = ["# Physical plans (generated by tools/plans.py at " + os.path.basename(sf) + ")", "",
           "Plans are taken before execution (AQE may still re-plan joins at run time; at this",
           "scale small sides become broadcasts, at cluster scale they stay shuffle joins).", ""]
    for title, note, df in items:
        out += [f"## {title}", "", note, "", "```", plan_text(df).rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
