"""Every catalogue query against its SQL twin on the smallest tables; the others must give rows."""

import oracle
import pytest

from tidemark import registry

registry.load_all()
SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"fft_velocity_anomalies"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        problem = oracle.difference(df, duck, registry.ORACLES[name])
        assert problem is None, problem
    elif name not in MAY_BE_EMPTY:
        assert df.limit(1).count() == 1


def test_names_and_coverage():
    assert len(registry.QUERIES) > 190 and set(registry.ORACLES) <= set(registry.QUERIES)
