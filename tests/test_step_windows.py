"""Queries over step windows against their twins, on windows that the given tables do not have."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from aerolake.operators import responses
from aerolake.plans import registry
from tests.oracle import same_rows

BEGIN = datetime.datetime(2024, 1, 1)


def against_twin(spark, folder, name: str, series: dict[int, list[float]], gap_s: float = 60.0):
    """The query's rows over events of these values, equal to its SQL's."""
    rows = [(user, BEGIN + datetime.timedelta(seconds=gap_s * i + user / 1000), value) for user, values in series.items() for i, value in enumerate(values)]
    users, times, values = zip(*rows, strict=True)
    table = {"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * len(rows), "value": pa.array(values, pa.float64())}
    pq.write_table(pa.table(table), folder / "events.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    found = registry.QUERIES[name](spark, str(folder))
    same_rows(found, con, registry.ORACLES[name])
    return found.collect()


#: Of users 1 and 4 a step's samples before and after it have the same mean, so the step has no size; user 4 has others too.
LEVEL = [5.0, 0.0, 10.0, 5.0, 5.0]
EVEN = {1: LEVEL, 2: [0.0] * 8 + [10.0, 14.0, 9.0] + [10.0] * 12, 3: [50.0] * 6 + [20.0] * 30, 4: LEVEL + [5.0] * 30 + [40.0, 52.0, 35.0] + [40.0] * 30}


def test_steps_without_size_are_not_assessed(spark, tmp_path):
    found = against_twin(spark, tmp_path, "assess_metrics", EVEN)
    assert 1 not in {r["user_id"] for r in found} and {2, 3} <= {r["user_id"] for r in found}


def test_steps_without_size_lead_to_no_recommendation(spark, tmp_path):
    found = against_twin(spark, tmp_path, "pid_recommend", EVEN)
    assert 1 not in {r["user_id"] for r in found} and 2 in {r["user_id"] for r in found}


def test_steps_without_size_have_no_metrics(spark, tmp_path):
    found = {(r["user_id"], r["step"]) for r in against_twin(spark, tmp_path, "rise_settle_metrics", EVEN)}
    assert not found & {(1, 0), (4, 0)} and {2, 3, 4} == {user for user, _ in found}


@pytest.mark.parametrize(("gap_s", "most_hz"), [(400.0, 80), (60.0, 480)])
def test_mean_responses_at_any_rate(spark, tmp_path, gap_s, most_hz):
    rng = np.random.default_rng(4)
    values = {user: np.round(np.repeat(rng.uniform(-90, 90, 6), 200) + rng.normal(0, 2, 1200), 2).tolist() for user in (0, 1, 2)}
    found = against_twin(spark, tmp_path, "time_domain_response", values, gap_s)
    rates = {r["source"]: r["rate_hz"] for r in found}
    assert len(rates) == 3 and 0.8 * most_hz < max(rates.values()) < most_hz
    assert all(max(r["lag"] for r in found if r["source"] == s) == int(1.5 * rate) - 1 for s, rate in rates.items())


def test_jumps_on_the_threshold_are_summed_as_by_sql():
    con = duckdb.connect()
    for seed in range(200):
        rng = np.random.default_rng(seed)
        head = np.round(rng.exponential(50, 10), 2)
        late = np.round(rng.permutation(head) + 5, 2)
        desired = [*head, *[0.0] * 11, *late, *[0.0] * 9]
        jump = con.execute("select list_avg($1::double[]) - list_avg($2::double[])", [late.tolist(), head.tolist()]).fetchone()[0]
        assert (responses.window_response(desired, rng.normal(0, 20, 40).tolist(), 20, 20, 20) is not None) == (abs(jump) >= 5)
