"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import database, differences

import __spark_entry__ as entry
from hierspark.plans.oracles import ORACLES
from hierspark.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROWS_ONLY = {"pca_fit", "pca_variance", "pca_project", "logreg_fit", "logreg_score", "stratified_cv", "second_stage_path"}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_only_model_fits_go_without_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(name, df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
