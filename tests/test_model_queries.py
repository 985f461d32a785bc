import inspect

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from sparkpanel.operators import models as MD
from sparkpanel.plans import q_models


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(str(i), 1 if i % 5 < 3 else 0, float(i % 7) + 2 * (i % 5 < 3), "SIM" if i % 2 else None) for i in range(60)]
    return spark.createDataFrame(rows, "ra string, y int, a double, bolsa string")


def test_every_model_key_is_compared_by_a_query_at_its_defaults(monkeypatch):
    """Each key goes to ``compare`` from a registered query, without settings of its own."""
    asked = []

    def compare(train, test, numeric, categorical, **kw):
        assert set(kw) == {"models"}
        asked.extend(kw["models"])

    monkeypatch.setattr(q_models, "train_test", lambda spark, sf: (None, None))
    monkeypatch.setattr(MD, "compare", compare)
    for name, query in E.queries().items():
        if name.startswith("compare_") and inspect.getmodule(query) is q_models:
            query(None, "")
    assert sorted(asked) == sorted(MD.MODEL_KEYS)


@pytest.mark.parametrize("cfg", [MD.ModelConfig("xgb", xgb_trees=5), MD.ModelConfig("cat", cat_iterations=5, cat_depth=3)],
                         ids=lambda c: c.name)
def test_boosting_fits_and_ranks(spark, pairs, cfg):
    board = MD.compare(pairs, pairs, ["a"], ["bolsa"], models=("dummy", cfg.name), id_col="ra",
                       configs={cfg.name: cfg}).collect()
    assert [r.model for r in board] == [cfg.name, "dummy"]  # higher AUC than the constant model
    fm = MD.fit(pairs, ["a"], ["bolsa"], cfg, id_col="ra")
    scores = MD.predict(fm, pairs).select("score")
    assert scores.where(F.col("score").between(0, 1)).count() == 60 and scores.distinct().count() > 1
    assert fm.model.stages[-1].getNumTrees == 5
