"""Every registered query equals its SQL twin on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks import operators
from checks.compare import connect, differences
from checks.reports import report_queries

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


OWN = sorted({**operators.QUERIES, **report_queries()})


def test_every_query_has_a_twin():
    assert set(OWN) <= set(ORACLES)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, sf_dir, database, name):
    result = QUERIES[name](spark, sf_dir)
    assert differences(result, database, ORACLES[name]) == []


@pytest.fixture(scope="module")
def later(sf_dir, database, tmp_path_factory):
    """The data set twenty years on, with lines of no known day."""
    folder = tmp_path_factory.mktemp("later")
    for path in Path(sf_dir).glob("*.parquet"):
        if path.stem not in ("orders", "lineitem"):
            (folder / path.name).symlink_to(path)
    for table, day, known in (("orders", "o_orderdate", "true"), ("lineitem", "l_shipdate", "l_orderkey % 50 > 0")):
        moved = f"case when {known} then {day} + interval 20 year end as {day}"
        database.execute(f"copy (select * replace ({moved}) from {table}) to '{folder / table}.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["r06", "r07"])
def test_refunds_of_any_day_are_reported(spark, sf_dir, later, name):
    result = QUERIES[name](spark, later)
    assert result.count() == QUERIES[name](spark, sf_dir).count() > 0
    assert differences(result, connect(later), ORACLES[name]) == []


def test_entry_returns_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
