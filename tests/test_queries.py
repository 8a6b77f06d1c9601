"""Every registered wafer query against its SQL; those without SQL by what must hold."""

import pytest

from siltrace.plans.oracles import ORACLES
from siltrace.plans.queries import QUERIES
from siltrace.sources.dimensions import CLASSES
from tests.sqlcheck import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_lots_are_never_split(spark, sf):
    found = QUERIES["lot_split"](spark, sf).groupBy("lot").agg({"is_test": "max"}).count()
    assert found == QUERIES["lot_split"](spark, sf).select("lot", "is_test").distinct().count()


def test_out_of_fold_scores_cover_every_row_once(spark, sf):
    out = QUERIES["oof_scores"](spark, sf)
    own = out.collect()
    assert len({r.vec_id for r in own}) == len(own) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert all(0 <= r.p <= 1 for r in own)
    folds = {}
    for r in own:
        assert folds.setdefault(r.lot, r.fold) == r.fold


@pytest.mark.parametrize("name", ["calibrated_rules", "calibrated_structural"])
def test_calibrated_rules_judge_every_wafer(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == QUERIES["wafer_yield"](spark, sf).count() and all(r.y_pred in (*CLASSES, "CLEAN") for r in rows)


@pytest.mark.parametrize("name, least", [("tree_pred", 0.5), ("rf_pred", 0.6), ("boost_pred", 0.5)])
def test_models_judge_the_test_lots(spark, sf, name, least):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables have two lots
    rows = QUERIES[name](spark, sf).collect()
    held = {r.wafer for r in QUERIES["lot_split"](spark, sf).filter("is_test").collect()}
    assert {r.wafer for r in rows} <= held
    assert sum(r.y_true == r.y_pred for r in rows) >= least * len(rows) > 0
