"""A sample of registered queries against their DuckDB oracles (sf0.001);
``tools/check.py`` runs all of them at sf0.01."""

import math

import duckdb
import pytest

from cartwalk.plans.registry import load_all, oracle_text
from cartwalk.sources.tables import TABLES, table_path
from conftest import SF001

SAMPLE = ["rec_topk", "m_map", "prof_length_stats", "time_weekday", "text_item_descrip",
          "feat_cyclic_literal", "sim_top_items", "session_accumulate", "io_interactions"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v if isinstance(v, (int, bool, str)) or v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, con, name):
    q = load_all()[name]
    df = q.build(spark, SF001)
    cols = df.columns
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)
    cur = con.execute(oracle_text(q))
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == want
