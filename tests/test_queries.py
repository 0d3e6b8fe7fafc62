"""Registered queries beside DuckDB on the smallest tables; tools/compare.py runs all of them."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tontine.plans.claim_sql import fitted

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import rows  # noqa: E402

NAMES = (
    "pool_overview pool_targets pool_features cleaning_report one_to_one_check request_rejections stratified_split"
    " event_index validation_gate resolved_models keyed_fingerprints request_rates alert_state nearest_centroid"
).split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


def duck_over(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("dependent", [False, True])
def test_claim_model_sql_fits_the_model(spark, sf, tmp_path, dependent):
    """Whether the model beats chance is fitted by the SQL too: it does where labels follow a feature, and not on the plain tables."""
    folder = sf
    if dependent:  # returned items of the nations 0 to 11 only
        folder = str(tmp_path)
        for path in glob.glob(f"{sf}/*.parquet"):
            if os.path.basename(path) != "lineitem.parquet":
                os.symlink(path, f"{folder}/{os.path.basename(path)}")
        duck_over(sf).execute(
            f"""COPY (SELECT l.* REPLACE (CASE WHEN c_nationkey < 12 THEN l_returnflag WHEN l_returnflag = 'R' THEN 'A' ELSE l_returnflag END AS l_returnflag)
                FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
                TO '{folder}/lineitem.parquet' (FORMAT parquet)"""
        )
    got = entry.queries()["stored_claim_model"](spark, folder).toPandas()
    want = duck_over(folder).execute(entry.oracle_sql()["stored_claim_model"]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
    assert bool(got["better_than_chance"][0]) is dependent


def test_claim_model_sql_weights_are_the_optimum(sf):
    """The slope of the penalised loss vanishes at the weights of every fold, by NumPy."""
    duck = duck_over(sf)
    points = duck.execute(fitted("points") + "SELECT fold, y, places, parts FROM points WHERE NOT is_test").fetchall()
    weights = dict(duck.execute(fitted("weights") + "SELECT m, b FROM weights").fetchall())
    assert sorted(weights) == [0, 1, 2, 3, 4]
    for m, b in weights.items():
        b = np.array(b)
        slope = np.where(np.arange(len(b)) > 0, b, 0.0)
        for fold, y, places, parts in points:
            if fold != m:
                at = np.array(places) - 1
                slope[at] += (1.0 / (1.0 + np.exp(-(b[at] @ parts))) - y) * np.array(parts)
        assert np.abs(slope).max() < 1e-5
