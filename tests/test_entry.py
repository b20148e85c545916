"""The entry works with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {top!r} and name.startswith({name!r}):
            raise ImportError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith("op") or n == "pipeline" for n in e.queries()))
"""


def counts(name):
    said = subprocess.run([sys.executable, "-c", HIDE.format(top=name.split(".")[0], name=name)], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    return list(map(int, said.stdout.split()))


@pytest.mark.parametrize("name", ["public_tokenizers", "corpus_pipeline", "aerolake.llm"])
def test_other_queries_work_without(name):
    queries, oracles, own = counts(name)
    assert own == 0 and queries >= 100 and oracles == queries
