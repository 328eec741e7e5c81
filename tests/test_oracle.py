"""Every registered query of the library proper against its SQL, on the smallest tables."""

import pytest

from quillgauge.plans import registry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLE_SQL:
        assert difference(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None
    else:
        assert registry.QUERIES[name](spark, SF).count() >= 0
