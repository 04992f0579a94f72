"""Correlations of values that don't change, against the queries' own SQL."""

import duckdb
import numpy as np
import pytest

from specklegrid import catalog


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Images whose last two values are equal, with a constant run within, constant as a whole, zero with both signs, and with missing values."""
    folder = str(tmp_path_factory.mktemp("runs"))
    rng = np.random.default_rng(5)
    e = rng.normal(0, 0.1, (14, 64)).round(4).tolist()
    e[1][62] = e[1][63]
    e[3][10:41] = [0.123] * 31
    e[5] = [0.077] * 64
    e[7] = [0.0, -0.0] * 32
    e[9][3], e[9][20], e[10][21], e[10][22] = None, None, None, None
    e[11][5:25] = [None] * 19 + [0.5]  # one pair, and then none, in a window
    e[12][4:30] = [None] * 26
    spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(e)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_sliding_correlation_of_constant_runs(spark, runs):
    name = "sliding_correlation_pixels"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{runs}/embeddings.parquet/*.parquet')")
    want = c.execute(catalog.oracle_sql()[name]).fetchall()
    found = [tuple(r) for r in catalog.queries()[name](spark, runs).select("image_id", "i", "r").collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert sum(r != r for _, _, r in want) > 100 and any(r is None for _, i, r in want if i <= 44)
