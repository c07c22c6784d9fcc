"""Compare a registered query with its DuckDB twin."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tests.oracle_harness import canon, duck  # noqa: E402


def same_as_sql(spark, module, name, sf_dir="/root/testdata/sf0.001"):
    df = module.QUERIES[name](spark, sf_dir)
    res = duck(sf_dir).execute(module.ORACLES[name])
    cols = [d[0] for d in res.description]
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon(cols, res.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
