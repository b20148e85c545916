from __future__ import annotations

import pytest

from aerolake.plans import registry
from tests.oracle import duck, same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data_dir, name):
    result = registry.QUERIES[name](spark, data_dir)
    if sql := registry.ORACLES.get(name):
        same_rows(result, duck(data_dir), sql)
    else:
        assert result.count() > 0
