"""Windows of canonical and plain tokens against windows listed one by one."""
import random

import pytest
from pyspark.sql import functions as F

from cartwalk.llm import decontaminate as D


@pytest.mark.parametrize("plain", [False, True])
def test_windows_are_told_apart_by_their_tokens(spark, plain):
    rnd = random.Random(3)
    texts = [[rnd.choice(["a", "b", D.NUMBER, D.NAME]) for _ in range(n)] for n in [*range(12), 40]]
    sizes = [4, 5, 7, 8]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t array<string>")
    rows = df.select("id", F.explode(D._windows(F.col("t"), sizes, plain)).alias("w")).select("id", "w.h", "w.pos").collect()
    want = [(i, p, k, tuple(t[p:p + k])) for i, t in enumerate(texts) for k in sizes for p in range(len(t) - k + 1)]
    if not plain:
        want = [x for x in want if sum(w not in (D.NUMBER, D.UNIT, D.NAME) for w in x[3]) >= D.MIN_LITERAL]
    assert sorted((r.id, r.pos) for r in rows) == sorted(x[:2] for x in want)
    # equal hashes stand for equal windows and the other way round
    assert len({r.h for r in rows}) == len({x[2:] for x in want})


def test_a_window_is_not_read_token_by_token(spark):
    text = str(D._windows(F.col("t"), [8])).lower()
    assert text.count("get(") <= 2
