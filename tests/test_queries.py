"""Every registered core query against its SQL on the smallest tables, and the registry itself."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from contractlake.jobs import queries as core

from .oracle import same

SF = "/root/testdata/sf0.001"
SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(spark, SF, core.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pair", "level", "version", "reasons"]
    assert df.count() > 0


def test_registry_needs_no_session():
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, check=True)
    n, ok = out.stdout.split()
    assert int(n) >= len(SQL) and ok == "True"
