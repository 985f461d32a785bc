import pytest

import __spark_entry__ as E
from sparkpanel.plans import catalog

catalog.load_all()
NAMES = sorted(catalog.QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["year_t", "year_t1"]
    assert df.count() >= 0


def test_catalog_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    for name in ("compare_models", "train_baseline"):  # fits without a closed form
        assert name in q and name not in o
    assert {"batch_score", "evaluate_bundle", "train_temporal_dummy", "tuning_folds"} <= set(o)


@pytest.mark.parametrize("name", NAMES)
def test_every_registered_query_runs_on_smallest_tables(spark, name):
    """The panel queries; the training-data operators have tests of their own beside them."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(df.columns) > 0
    df.write.format("noop").mode("overwrite").save()
