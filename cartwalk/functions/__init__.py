"""Column-expression helpers shared by the operators."""

from cartwalk.functions.exprs import (
    r6, rank_key, safe_div, as_long, l1_share, log2,
)

__all__ = ["r6", "rank_key", "safe_div", "as_long", "l1_share", "log2"]
