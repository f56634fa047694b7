"""Every registered query agrees with its SQL on the smallest data set."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from linewatch.plans import catalog, oracles

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import connect, difference  # noqa: E402

from .conftest import DATA  # noqa: E402

NAMES = list(catalog.all_queries())


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if name in oracles.all_sql():
        assert difference(got, duck.execute(entry.oracle_sql()[name]).df()) == ""
    else:
        assert len(got)


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 31


def test_only_unrepeatable_results_have_no_sql():
    without = set(catalog.all_queries()) - set(oracles.all_sql())
    assert without == {"M3_fit_forest", "M3_train_and_score"}  # their checks, M3_tree_shapes and M3_score_checks, have
