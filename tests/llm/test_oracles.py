from __future__ import annotations

import pytest

from aerolake.llm import queries
from tests.oracle import duck, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data_dir, name):
    same_rows(queries.QUERIES[name](spark, data_dir), duck(data_dir), queries.ORACLES[name])
