"""Plans of the analyses of a fleet: no cross join, no Python row functions, series sorted once where that is all they need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aerolake import api
from tests.test_api import flight, imu_of


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [api.fft, api.pid, api.step_response, api.sysid, api.quality], ids=lambda f: f.__name__)
def test_fleet_plans(spark, make):
    flights = api.Flights("ardupilot", pid=flight(spark, 250.0), imu=imu_of(spark, {"gx": 80.0}, n=600))
    plan = plan_of(make(flights))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan


def test_rates_do_not_multiply_scans(spark, tmp_path):
    imu = imu_of(spark, {"gx": 80.0}, n=600)
    imu.write.parquet(str(tmp_path / "imu"))
    plan = plan_of(api.gyro_spectrum(api.Flights("ardupilot", imu=spark.read.parquet(str(tmp_path / "imu")))))
    # One for the samples, one for their gaps.
    assert plan.count("FileScan parquet") <= 2
    narrow = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert all("ax" not in line.split("ReadSchema")[-1] for line in narrow)


def test_one_plan_holds_all_rates(spark):
    fleet = imu_of(spark, {"gx": 80.0}, 400.0, 900, "a").unionByName(imu_of(spark, {"gx": 80.0}, 1600.0, 1800, "b"))
    found = api.gyro_spectrum(api.Flights("ardupilot", imu=fleet)).groupBy("flight_id").agg(F.max("freq").alias("top"), F.max("bin").alias("bins")).collect()
    assert {r["flight_id"]: (round(r["top"]), r["bins"]) for r in found} == {"a": (200, 256), "b": (800, 900)}
