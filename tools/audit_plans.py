"""Plan audit: build every registered query and flag physical plans with a
cartesian product / nested-loop join or a Python UDF (building a model-fit
query runs its fits)."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from sparkpanel.plans import catalog  # noqa: E402
from sparkpanel.session import get_spark  # noqa: E402

FLAGS = ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross", "BatchEvalPython", "ArrowEvalPython")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("audit", "local[8]", 8)
    catalog.load_all()
    bad = {}
    for name, fn in catalog.QUERIES.items():
        qe = fn(spark, sf)._jdf.queryExecution()
        text = qe.optimizedPlan().toString() + qe.executedPlan().toString()
        hits = [f for f in FLAGS if f in text]
        if hits:
            bad[name] = hits
    print("flagged:", bad or "none")
    spark.stop()


if __name__ == "__main__":
    main()
