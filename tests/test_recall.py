"""Recall of approximate search against the exact one."""

from codelake import catalog
from codelake.operators import vectors
from codelake.plans.views import table


def test_lsh_finds_nine_of_ten_neighbours(spark):
    d = "/root/testdata/sf0.1"
    v = table(spark, d, "embeddings")
    want = {(r.query_id, r.vec_id) for r in vectors.nearest(v, v.where("vec_id % 100 = 0"), 10).collect()}
    rows = catalog.QUERIES["v04_lsh"](spark, d).collect()
    got = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(got) and {r["rank"] for r in rows} == set(range(1, 11))
    assert len(got & want) >= 0.9 * len(want)
