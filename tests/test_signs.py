"""Halves and zeros that come out of rounding, against the queries' own SQL."""

import duckdb
import numpy as np
import pytest

from specklegrid import catalog
from specklegrid.sources import formats


def test_png_halves_go_up():
    """0.5, 2.5 and 178.5 of 255 are halves; to the even number they would go down."""
    v = np.array([[0.5, 2.5, 178.5, 1.5, 0.49, 255.0]])
    assert formats.coloured(v + 0j)[0, :, 0].tolist() == [1, 3, 179, 2, 0, 255]


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """An image with numbers that round to zero from both sides."""
    folder = str(tmp_path_factory.mktemp("tiny"))
    e = [float(x) for x in np.linspace(-0.2, 0.3, 64)]
    e[0], e[2], e[4], e[6], e[10] = -3e-7, 3e-7, -0.0, 0.0, -4e-7
    spark.createDataFrame([(1, e, 0), (2, e[::-1], 1)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def same(spark, folder: str, name: str) -> None:
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    want = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in catalog.queries()[name](spark, folder).select(*columns).collect()) == want


@pytest.mark.parametrize("name", ["reflection_lists", "panels", "matrices_through_files"])
def test_zeros_keep_their_signs(spark, tiny, name):
    same(spark, tiny, name)


@pytest.mark.parametrize("name", ["phase_image", "expr_parts"])
def test_phase_of_negative_zero(spark, tiny, name):
    same(spark, tiny, name)
