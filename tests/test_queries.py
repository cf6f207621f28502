"""A choice of queries against their SQL; the driver runs them all."""

import os

import duckdb
import pandas as pd
import pytest

from diffspark.plans.queries import QUERIES, SQL

NAMES = ["ring_summary", "spot_statistics", "corrected_pixels", "centroids", "top_peaks", "drawn_frames", "sampled_peaks", "error_statistics", "early_stops", "peak_file_index", "multires_cells", "oriented_spots", "local_maxima", "centres_of_mass", "reconstruction_errors", "spaced_maxima", "tiled_spots", "residual_rings"]


def rows(df, columns):
    out = [tuple(None if pd.isna(v) else v for v in r) for r in df[columns].astype(object).values.tolist()]
    return sorted(out, key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    got, expected = QUERIES[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    assert set(got.columns) == set(expected.columns)
    assert rows(got, list(got.columns)) == rows(expected, list(got.columns))
