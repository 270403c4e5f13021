"""Every registered query of the library against its SQL."""

from __future__ import annotations

import inspect
import math

import duckdb
import pytest

from gridscore.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    def plain(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT"):
            return "none"
        return str(bool(v)) if isinstance(v, bool) or type(v).__name__ == "bool_" else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def sf_dir() -> str:
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, sf_dir, name):
    found = catalogue.queries()[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(found) and all(not (isinstance(v, float) and math.isinf(v)) for v in found.to_numpy().ravel())
        return
    expected = con.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert _rows(found) == _rows(expected)


def test_nulls_draw_as_often_as_the_reference(spark, sf_dir, monkeypatch):
    from gridscore.operators import resample, search

    found = {}

    def watch(module, function, argument):
        real = getattr(module, function)
        bound = inspect.signature(real)

        def run(*args, **kwargs):
            call = bound.bind(*args, **kwargs)
            call.apply_defaults()
            found[function] = call.arguments[argument]
            return real(*args, **kwargs)

        monkeypatch.setattr(module, function, run)

    for function, argument in (("permutation_metrics", "n_perm"), ("time_permuted", "n_perm"), ("phase_randomised", "n_perm"), ("bootstrap_pick", "n_boot")):
        watch(resample, function, argument)
    watch(search, "optimise_bands", "n")
    for name in ("q_perm_null", "q_time_null", "q_bootstrap", "q_loso_search"):
        catalogue.queries()[name](spark, sf_dir)
    twins = catalogue.queries()["q_phase_null"](spark, sf_dir).toPandas()
    assert found == {"permutation_metrics": 500, "time_permuted": 100, "phase_randomised": 100, "bootstrap_pick": 100, "optimise_bands": 20}
    assert (twins.power - twins.null_power).abs().max() < 1e-5 and (twins.null_std > 0).any() and twins.p.between(0, 1).all()
