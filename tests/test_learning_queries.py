import pytest
from pyspark.sql import functions as F

from pairmatch.operators import boosting as B
from pairmatch.plans import QUERIES
from pairmatch.plans import learning_queries as L

SMALL = "/root/testdata/sf0.001"


class Stop(Exception):
    pass


def stopped_at(spark, monkeypatch, name, step):
    """What a query gives to a step of the fit, which is not run."""

    def stop(*args, **settings):
        raise Stop(args, settings)

    monkeypatch.setattr(B, step, stop)
    with pytest.raises(Stop) as stopped:
        QUERIES[name](spark, SMALL)
    return stopped.value.args


@pytest.mark.parametrize("name", ["boosted_trees", "batch_score", "save_load_model"])
def test_boosting_runs_over_the_whole_job(spark, monkeypatch, name):
    (rows, *given), _ = stopped_at(spark, monkeypatch, name, "fit_model")
    assert not given
    sizes = rows.select(F.size("inputs").alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [792]
    assert (B.Settings().rounds, B.Settings().depth, B.Settings().patience) == (500, 9, 100)


def test_tree_queries_give_results(spark, monkeypatch):
    table = L._table_rows(spark, SMALL)
    monkeypatch.setattr(L, "_table_rows", lambda spark, sf: table)
    n = {r["type"]: r["count"] for r in table.groupBy("type").count().collect()}
    held = L.boosted_trees(spark, SMALL).collect()
    assert 0 < len(held) < n["TR"] and all(0 < r["is_duplicate_1"] < 1 for r in held)
    assert L.batch_score(spark, SMALL).count() == n["TS"]
    stored = L.save_load_model(spark, SMALL)
    by = stored.groupBy("test_id").agg(F.count("*").alias("n"), F.min("is_duplicate_1").alias("a"),
                                       F.max("is_duplicate_1").alias("b")).collect()
    assert len(by) == sum(n.values()) and all(r["n"] == 2 and r["a"] == r["b"] for r in by)
    scores = L.grid_search_trees(spark, SMALL).collect()
    assert len({r["setting"] for r in scores}) == 12
    assert all(0 < r["log_loss"] < 2 for r in scores)
